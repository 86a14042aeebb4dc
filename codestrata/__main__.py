"""python -m codestrata: init, analyze, audit, status, report, chat, mcp-server."""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codestrata", description="Architecture of C++ code bases on Spark")
    p.add_argument("command", choices=["init", "analyze", "audit", "status", "report", "chat", "mcp-server"])
    p.add_argument("path", nargs="?", default=".", help="the source tree")
    p.add_argument("--store", default=None, help="where the tables are kept; <path>/.codestrata by default")
    p.add_argument("--from", dest="start", choices=["scan", "review"], help="forget what comes from this step on")
    p.add_argument("--skills", default="", help="a folder with architecture.md and design_critic.md")
    p.add_argument("--output", default="report.html")
    p.add_argument("--strategy", default="auto", choices=["auto", "explicit", "folder", "namespace", "community"])
    a = p.parse_args(argv)
    root = a.path if "://" in a.path else os.path.abspath(a.path)
    place = a.store or f"{root}/.codestrata"
    if a.command == "init":
        os.makedirs(place, exist_ok=True)
        print(f"Tables will be kept in {place}")
        return 0

    from pyspark.sql import SparkSession

    from codestrata.tools import host
    from codestrata.tools.client import default_client
    from codestrata.tools.registry import Context, run_tool, show_status
    from codestrata.tools.store import Store

    spark = SparkSession.builder.appName("codestrata").getOrCreate()
    context = Context(spark, root, Store(spark, place), default_client, a.skills)
    show = lambda name, **args: print(run_tool(context, name, args))
    if a.start == "scan":
        context.store.clear_all()
    elif a.start == "review":
        context.store.clear("design_critic_subtree", "design_critic_module", "arch_module_review")
    if a.command == "analyze":
        show("scan_source")
        show("architecture_audit", strategy=a.strategy)
        show("architecture_conclusion")
    elif a.command == "audit":
        show("scan_source", force=True)
        show("architecture_audit", strategy=a.strategy)
    elif a.command == "status":
        show("get_overview")
        print(show_status(context))
    elif a.command == "report":
        show("generate_report", path=a.output)
    elif a.command == "chat":
        talk = host.Host(context, default_client())
        for line in sys.stdin:
            print(talk.ask(line.strip()))
    else:
        import asyncio

        from mcp.server.stdio import stdio_server

        server = host.mcp_server(context)

        async def serve() -> None:
            async with stdio_server() as (r, w):
                await server.run(r, w, server.create_initialization_options())

        asyncio.run(serve())
    return 0


if __name__ == "__main__":
    sys.exit(main())
