"""Command line: prep, max, nmost, ctree."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kmerloom import api
from kmerloom.sources import files, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kmerloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    prep = verbs.add_parser("prep", help="write a store from sequence files")
    prep.add_argument("source")
    prep.add_argument("out")
    prep.add_argument("--format", choices=["fasta", "genbank"], default="fasta")
    prep.add_argument("--moltype", choices=["dna", "rna"], default="dna")
    prep.add_argument("--whole-files", action="store_true")
    prep.add_argument("--overwrite", "-F", action="store_true")
    for name in ("max", "nmost", "ctree"):
        v = verbs.add_parser(name)
        v.add_argument("store")
        v.add_argument("out")
        v.add_argument("-k", type=int, default=6)
        if name == "ctree":
            v.add_argument("--distance", choices=["mash", "euclidean"], default="mash")
            v.add_argument("--sketch-size", type=int)
            v.add_argument("--canonical", action="store_true")
            continue
        v.add_argument("--include")
        v.add_argument("--chunks", type=int)
        if name == "nmost":
            v.add_argument("-n", type=int, default=10)
        else:
            v.add_argument("--least", type=int, default=7)
            v.add_argument("--most", type=int)
            v.add_argument("--stat", choices=["stdev", "cov"], default="stdev")
    for v in verbs.choices.values():
        v.add_argument("--limit", "-L", type=int)
        v.add_argument("--seed", type=int, default=0)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("kmerloom").getOrCreate()
    try:
        if a.verb == "prep":
            store.prep(spark, a.source, a.out, a.format, a.moltype, a.whole_files, a.limit, a.seed, a.overwrite)
            return 0
        rows = store.get_store(spark, a.store)
        if a.verb == "ctree":
            files.write_newick(api.cluster_tree(rows, a.distance, a.k, a.sketch_size, a.canonical, seed=a.seed, limit=a.limit), a.out)
        elif a.verb == "nmost":
            files.write_selection(api.select_nmost(rows, a.n, a.k, files.names_option(a.include), a.seed, a.limit, a.chunks, unique=False), a.out)
        else:
            files.write_selection(api.select_max(rows, a.least, a.most, a.stat, a.k, files.names_option(a.include), a.seed, a.limit, a.chunks, unique=False), a.out)
    except ValueError as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
