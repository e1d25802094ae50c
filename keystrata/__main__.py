"""A prompt: ``python -m keystrata FOLDER``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from keystrata.session import Session


def main(folder: str) -> None:
    spark = SparkSession.builder.appName("keystrata").getOrCreate()
    session = Session(spark, folder)
    while True:
        try:
            line = input("sql> ").strip()
        except EOFError:
            return
        if line.lower() in ("quit", "exit"):
            return
        if line:
            result = session.sql(line)
            print(result.table() if result.ok else f"Error: {result.message}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "file:///tmp/keystrata")
