"""Compare the result types of every query with its DuckDB oracle (normalised type names)."""
import os
import re
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)
from envmon.session import get_session
import __spark_entry__ as E
from oracle_check import duck


def main():
    spark = get_session("local[8]", shuffle_partitions=8, conf={"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    SF_DIR = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con = duck(SF_DIR)
    def sp(t):
        t = t.simpleString()
        return {"int": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int8", "double": "float64",
                "float": "float32", "string": "string", "boolean": "bool", "date": "date",
                "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}.get(t, t)
    def dk(t):
        t = str(t).upper()
        m = re.match(r"DECIMAL\((\d+),(\d+)\)", t)
        if m: return f"decimal({m.group(1)},{m.group(2)})"
        return {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "float64",
                "FLOAT": "float32", "VARCHAR": "string", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "timestamp",
                "HUGEINT": "int128", "TIMESTAMP WITH TIME ZONE": "timestamptz"}.get(t, t)
    qs, ors = E.queries(), E.oracle_sql()
    for k, sql in ors.items():
        df = qs[k](spark, SF_DIR)
        s = {f.name: sp(f.dataType) for f in df.schema.fields}
        rel = con.sql(sql)
        d = {n: dk(t) for n, t in zip(rel.columns, rel.types)}
        diff = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
        if diff: print(k, diff)
    print("done")


if __name__ == "__main__":
    main()
