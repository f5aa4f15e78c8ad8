"""python -m noteforge list | run NAME DIR [--out PATH] [--show N] | search DIR QID [--alpha A] [--recall N] [--final N]."""

from __future__ import annotations

import argparse

from noteforge.plans import registry
from noteforge.session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="noteforge")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(registry.queries()))
    run.add_argument("dir")
    run.add_argument("--out")
    run.add_argument("--show", type=int, default=20)
    find = sub.add_parser("search")
    find.add_argument("dir")
    find.add_argument("qid", type=int)
    find.add_argument("--alpha", type=float, default=0.5)
    find.add_argument("--recall", type=int, default=100)
    find.add_argument("--final", type=int, default=10)
    a = parser.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = local_session()
    if a.command == "run":
        df = registry.queries()[a.name](spark, a.dir)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(a.show, truncate=100)
        return 0
    from pyspark.sql import functions as F

    from noteforge.operators import evaluation, retrieval
    from noteforge.plans.retrieval_queries import corpus

    texts, images, edges = corpus(spark, a.dir)
    query = texts.where(F.col("doc_row") == a.qid).select(F.col("doc_row").alias("qid"), F.lit("text").alias("modality"), "v")
    evaluation.result_lines(retrieval.search(query, texts, images, edges, a.recall, a.final, a.alpha).orderBy("rank")).show(a.final, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
