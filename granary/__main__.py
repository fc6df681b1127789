"""``python -m granary smoke`` runs a small memory from end to end; ``python -m granary trace FOLDER QUESTION`` shows how a memory answers (``--json`` or ``--html`` for other forms)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from granary.memory import Memory
from granary.operators import trace
from granary.sources import seeds
from granary.sources.tables import scratch


def main() -> None:
    p = argparse.ArgumentParser(prog="granary", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    smoke = commands.add_parser("smoke")
    smoke.add_argument("--memories", type=int, default=24)
    show = commands.add_parser("trace")
    show.add_argument("folder")
    show.add_argument("question")
    show.add_argument("--hint")
    form = show.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_const", dest="form", const=trace.to_json, default=trace.to_text)
    form.add_argument("--html", action="store_const", dest="form", const=trace.to_html)
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "trace":
        row = Memory(spark, a.folder).trace(spark.createDataFrame([("question", a.question)], "query_id string, text string"), hint=a.hint).first()
        print(a.form(row))
        return
    m = Memory(spark, scratch(spark, "smoke"))
    m.ingest(seeds.synthetic_memories(spark, a.memories), ["seq"])
    result, passages, facts = m.ask("Does Ivo like jazz records?")
    print(f"{result.intent} {result.recall_fingerprint}: {len(passages)} passages, {len(facts)} facts, {m.timing}")
    for r in passages[:3]:
        print(f"{r['rank']}. {r.score:.3f} {r.granularity}: {r.text}")


if __name__ == "__main__":
    main()
