"""Command line: python -m braidwork.cli blunt -i graph.gfa -o out [-p table]; python -m braidwork.cli extract -i graph.gfa -s NAME -r RADIUS."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from braidwork.operators.traversal import extract_subgraph, subgraph_name
from braidwork.plans.blunt import blunt_file
from braidwork.sources import gfa


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="braidwork")
    commands = top.add_subparsers(dest="command", required=True)
    b = commands.add_parser("blunt", help="blunt a graph")
    b.add_argument("input", nargs="?", help="GFA file (or -i)")
    b.add_argument("-i", "--input_gfa")
    b.add_argument("-o", "--output", required=True, help="folder for the blunted GFA")
    b.add_argument("-p", "--provenance", help="folder for the provenance table")
    b.add_argument("-t", "--threads", type=int, default=0, help="local cores, where no cluster is set (0: all)")
    b.add_argument("-V", "--verbose", action="store_true")
    e = commands.add_parser("extract", help="extract what lies around a segment")
    e.add_argument("-i", "--input_gfa", required=True)
    e.add_argument("-s", "--start", required=True)
    e.add_argument("-r", "--radius", type=int, required=True)
    e.add_argument("-o", "--output")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if getattr(args, "verbose", False) else logging.WARNING, format="%(asctime)s %(message)s")
    builder = SparkSession.builder.appName("braidwork")
    if getattr(args, "threads", 0):
        builder = builder.master(f"local[{args.threads}]")
    spark = builder.getOrCreate()
    path = args.input_gfa or getattr(args, "input", None)
    if not path:
        raise SystemExit("an input file is needed")
    if args.command == "blunt":
        blunt_file(spark, path, args.output, args.provenance)
        return
    graph = gfa.read_gfa(spark, path)
    segments, links = extract_subgraph(graph.segments, graph.links, args.start, args.radius)
    gfa.write_gfa(segments, gfa.named_links(graph.segments, links), args.output or subgraph_name(path, args.start, args.radius))


if __name__ == "__main__":
    main()
