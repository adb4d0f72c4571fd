"""Command line of the latent semantic analysis: ``python -m folium.lsa_cli FOLDER -c wfc --docs PARQUET``.

Command letters, done in this order: ``w`` counts words, ``f`` weighs them, ``c`` decomposes and compares documents, ``s``
lists sets, ``d`` lists similar documents by name; ``a`` stands for ``wfc``.
"""

from __future__ import annotations

import argparse

from folium.session import session
from folium.sources.lsa_files import LsaFolder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folium-lsa", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("folder", help="where the analysis keeps its files")
    p.add_argument("-c", "--command", required=True, help="command letters")
    p.add_argument("--docs", help="Parquet table with name and text, for w")
    p.add_argument("-r", "--rank", type=int, default=10)
    p.add_argument("-t", "--threshold", type=float, default=0.0)
    for letter, what in (("e", "leave out the documents that EXC names"), ("u", "write U"), ("s", "write S"), ("v", "write V")):
        p.add_argument(f"-{letter}", action="store_true", help=what)
    return p


def main(argv: list[str] | None = None, spark=None) -> None:
    args = parser().parse_args(argv)
    command = "wfc" if args.command == "a" else args.command
    if unknown := set(command) - set("wfcsd"):
        parser().error(f"unknown command letters: {''.join(sorted(unknown))}")
    if "w" in command and not args.docs:
        parser().error("w needs --docs")
    spark = spark or session("folium-lsa")
    files = LsaFolder(spark, args.folder)
    steps = {
        "w": lambda: files.count(spark.read.parquet(args.docs)),
        "f": files.weigh,
        "c": lambda: files.decompose(args.rank, args.threshold, args.e, args.u, args.s, args.v),
        "s": lambda: files.sets(args.threshold),
        "d": lambda: files.similar(args.threshold),
    }
    for letter, step in steps.items():
        if letter in command:
            step()


if __name__ == "__main__":
    main()
