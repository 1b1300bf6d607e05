"""Physical-plan summary of every registered query, as a cluster would plan it
(static and AQE broadcast thresholds off, so only explicit, size-checked broadcasts remain)."""
import re
import sys

sys.path.insert(0, "/root/repo")
import __spark_entry__ as E  # noqa: E402
from quillstat.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = get_session("local[8]", 8)
spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
print("| query | shuffles | reused | broadcasts | python nodes | joins | scans with pushed filters |")
print("| --- | --- | --- | --- | --- | --- | --- |")
for name, fn in E.queries().items():
    if name in ("month_union", "stream_ingest"):
        continue  # write/read round trips: their plans are the reads
    df = fn(spark, sf)
    p = df._jdf.queryExecution().executedPlan().toString()
    shuffles = len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (hashpartitioning|SinglePartition|rangepartitioning|RoundRobinPartitioning)", p))
    reused = p.count("ReusedExchange")
    bcast = p.count("BroadcastExchange")
    py = p.count("MapInPandas") + p.count("ArrowEvalPython") + p.count("BatchEvalPython")
    joins = len(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)", p))
    pushed = len(re.findall(r"PushedFilters: \[[^\]]", p))
    print(f"| `{name}` | {shuffles} | {reused} | {bcast} | {py} | {joins} | {pushed} |", flush=True)
