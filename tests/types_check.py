"""List result columns whose kind (integer, real, text, ...) differs between the engines."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import ROOT, oracle, test_session  # noqa: E402

from terrakit.registry import all_queries  # noqa: E402

KINDS = {
    "tinyint": "integer", "smallint": "integer", "int": "integer", "integer": "integer", "bigint": "integer",
    "double": "real", "float": "real", "string": "text", "varchar": "text", "boolean": "boolean",
}


def main() -> None:
    spark = test_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(f"{ROOT}/sf0.001")
    for name, q in sorted(all_queries().items()):
        if not q.sql:
            continue
        theirs = {r[0]: str(r[1]).lower() for r in con.execute(f"describe {q.sql}").fetchall()}
        ours = {f.name: f.dataType.simpleString() for f in q(spark, f"{ROOT}/sf0.001").schema.fields}
        for column, kind in ours.items():
            if KINDS.get(kind, kind) != KINDS.get(theirs.get(column), theirs.get(column)):
                print(name, column, kind, theirs.get(column), flush=True)


if __name__ == "__main__":
    main()
