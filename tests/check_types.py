"""List queries whose Spark column types differ from the DuckDB oracle's."""
import sys
sys.path.insert(0, "/root/repo"); sys.path.insert(0, "/root/repo/tests")
from oracle import duck
import __spark_entry__ as E
from quillstat.session import get_session

MAP = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
       "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE"}
sf = "/root/testdata/sf0.001"
spark = get_session("local[8]", 8)
con = duck(sf)
bad = 0
for name, fn in E.queries().items():
    df = fn(spark, sf)
    st = {f.name: MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(E.oracle_sql()[name])
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c)}
    if diff:
        bad += 1
        print(name, diff)
print("mismatching queries:", bad)
