"""The command line: ``python -m corvane index --root DIR`` and so on; every command prints JSON, `context` the text."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from corvane import __version__
from corvane.service import Repository, rows
from corvane.session import session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane", description=__doc__)
    out.add_argument("--root", default=".")
    out.add_argument("--state", help="where snapshots and facts are kept; by default below the root")
    out.add_argument("--master", default="local[*]")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name, *arguments: [p := commands.add_parser(name), *(p.add_argument(*a[0], **a[1]) for a in arguments)][0]
    arg = lambda *names, **options: (names, options)
    for name in ("version", "index", "status"):
        add(name)
    for name in ("find-symbol", "callers", "callees", "graph"):
        add(name, arg("name"))
    add("context", arg("task"), arg("--budget", type=int, default=8_000), arg("--method", default="knapsack", choices=["knapsack", "greedy"]))
    add("remember", arg("text"), arg("--anchor", action="append", default=[]), arg("--subject"), arg("--session"), arg("--source"), arg("--confidence", type=float, default=1.0))
    add("recall", arg("query", nargs="?"), arg("--fresh", action="store_true"))
    add("forget", arg("fact", nargs="+"))
    history = commands.add_parser("memory").add_subparsers(dest="action", required=True)
    for name, arguments in (("log", []), ("branches", []), ("diff", ["left", "right"]), ("revert", ["operation"]), ("branch", ["name"]), ("switch", ["name"]), ("rename", ["old", "new"]), ("delete", ["name"]), ("preview", ["name"]), ("merge", ["name"])):
        p = history.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        if name == "merge":
            p.add_argument("--resolve", action="append", default=[], metavar="FACT=CHOICE")
    return out


def answer(repository: Repository, args: argparse.Namespace):
    spark = repository.spark
    match args.command:
        case "index":
            return asdict(repository.index())
        case "status":
            return repository.status()
        case "find-symbol":
            return rows(repository.find_symbol(args.name).select("id", "path", "qualname", "kind", "start_line", "end_line", "signature"))
        case "callers" | "callees":
            return rows(repository.calls(args.name, args.command == "callers"))
        case "graph":
            edges, symbols = repository.neighbourhood(args.name)
            return {"edges": rows(edges), "symbols": rows(symbols.select("id", "path", "qualname", "kind"))}
        case "context":
            task = spark.createDataFrame([(0, args.task)], "query_id long, text string")
            return repository.context(task, args.budget, method=args.method).first().text
        case "remember":
            given = {k: v for k, v in (("subject", args.subject), ("session", args.session), ("source", args.source)) if v is not None}
            return {"commit": repository.remember(args.text, args.anchor, confidence=args.confidence, **given)}
        case "recall":
            return rows(repository.recall(args.query, not args.fresh).select("fact_id", "text", "freshness", "confidence", "score", "place"))
        case "forget":
            return {"forgotten": repository.facts.forget(spark.createDataFrame([(f,) for f in args.fact], "id string"))}
    store = repository.facts
    match args.action:
        case "log":
            return rows(store.table("operations").orderBy("seq", ascending=False))
        case "branches":
            return store.branches()
        case "diff":
            heads = store.branches()
            from corvane.operators import memory

            return rows(memory.diff(store.state(heads.get(args.left, args.left)), store.state(heads.get(args.right, args.right))))
        case "revert":
            return {"commit": store.revert([args.operation])}
        case "branch":
            return {"head": store.branch(args.name)}
        case "switch":
            store.switch(args.name)
        case "rename":
            store.rename(args.old, args.new)
        case "delete":
            store.delete(args.name)
        case "preview":
            return rows(store.preview(args.name))
        case "merge":
            chosen = [tuple(r.split("=", 1)) for r in args.resolve]
            return {"commit": store.merge(args.name, spark.createDataFrame(chosen, "fact_id string, choice string") if chosen else None)}
    return {"active": store.active}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return
    spark = session(args.master, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    found = answer(Repository(spark, args.root, args.state), args)
    print(found if isinstance(found, str) else json.dumps(found, ensure_ascii=False))


if __name__ == "__main__":
    main()
