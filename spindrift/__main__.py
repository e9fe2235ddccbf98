"""Command line: python -m spindrift [--data FOLDER] add | sync | list | info | remove | reindex | search | serve | version."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    p.add_argument("--data", help="folder of registry and chunks")
    p.add_argument("--config", default="", help="settings as TOML")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("add", "sync", "reindex"):
        v = verbs.add_parser(verb)
        v.add_argument("url" if verb == "add" else "library")
        v.add_argument("--pages", help="Parquet table of pages (url, html) instead of the web")
        if verb == "add":
            v.add_argument("--name", required=True)
            v.add_argument("--version", default="")
            v.add_argument("--description", default="")
            v.add_argument("--include", action="append", default=[])
            v.add_argument("--exclude", action="append", default=[])
    verbs.add_parser("list")
    for verb in ("info", "remove"):
        verbs.add_parser(verb).add_argument("library")
    search = verbs.add_parser("search")
    search.add_argument("library")
    search.add_argument("query")
    verbs.add_parser("serve", help="read tool calls as JSON lines, write answers as JSON lines")
    verbs.add_parser("version")
    return p


def provider(config):
    from .operators import embed

    if config.provider == "ollama":
        return embed.Ollama(config.model, config.base_url or "http://localhost:11434")
    if config.provider == "openai":
        return embed.OpenAI(config.model, config.api_key, config.base_url or "https://api.openai.com/v1")
    if config.provider == "local":
        return embed.Onnx(config.base_url or config.model)
    return embed.Fake() if config.provider == "fake" else embed.default()


def main(argv: list[str] | None = None, spark=None, out=None, lines=None) -> int:
    args = parser().parse_args(argv)
    out = out or sys.stdout
    if args.verb == "version":
        print(__version__, file=out)
        return 0
    from .plans.library import Library, call_tool, format_sections
    from .session import session
    from .sources.store import load_config
    from .sources.web import from_web

    config = load_config(args.config, data_path=args.data)
    spark = spark or session()
    pages = None
    if getattr(args, "pages", None):
        pages = spark.read.parquet(args.pages)
    elif args.verb in ("add", "sync", "reindex"):
        pages = from_web(concurrency=config.concurrency, timeout=config.request_timeout, most=config.max_body_bytes, rate=config.rate_limit)
    try:
        embeds = args.verb in ("add", "sync", "reindex", "search", "serve")
        library = Library(spark, config.data_path, provider(config) if embeds else None, config.candidate_count, config.final_chunks, max_pages=config.max_pages, max_depth=config.max_depth)
        if args.verb == "add":
            result = library.add(args.name, args.url, pages, args.version, args.description, args.include, args.exclude)
        elif args.verb in ("sync", "reindex"):
            result = getattr(library, args.verb)(library.find(args.library).library_id, pages)
        elif args.verb == "remove":
            result = library.remove(library.find(args.library).library_id)
        elif args.verb == "info":
            result = library.list().where(f"library_id = '{library.find(args.library).library_id}'").first().asDict()
        elif args.verb == "list":
            for r in library.list().toLocalIterator():
                print(f"{r.library_id}\t{r.name}\t{r.chunks} chunks\t{r.pages} pages\t{(r.synced_at or '')[:10]}", file=out)
            return 0
        elif args.verb == "search":
            print(format_sections(library.query(library.find(args.library).library_id, args.query)), file=out)
            return 0
        else:
            for line in lines or sys.stdin:
                call = json.loads(line)
                text, error = call_tool(library, call.get("tool", ""), call.get("arguments", {}))
                print(json.dumps({"text": text, "error": error}), file=out, flush=True)
            return 0
    except (LookupError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(result or {}), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
