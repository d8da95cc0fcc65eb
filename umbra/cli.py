"""Command line: cp and ls."""

from __future__ import annotations

import argparse
import sys

from umbra.engine import CopyOptions, copy, listing
from umbra.functions.detect import ALL_RULES, DEFAULT_RULES, DENIED
from umbra.functions.media import parse_override
from umbra.functions.throttle import parse_limit
from umbra.operators import services
from umbra.operators.providers import RuleDetector, check_options, detector, registered
from umbra.plans.planning import listing_totals
from umbra.session import session

#: Which providers each provider's own option means something to.
REMOTE_OPTIONS = {
    "gcp-project-id": ("gcp-dlp", "gemini-llm", "gcp-vertex-ai"), "gcp-region": ("gcp-vertex-ai",), "gcp-vertex-ai-text-model": ("gcp-vertex-ai",),
    "gcp-vertex-ai-image-model": ("gcp-vertex-ai",), "aws-region": ("aws-comprehend",), "ms-presidio-text-analyze-url": ("ms-presidio",),
    "ms-presidio-image-redact-url": ("ms-presidio",), "gemini-model": ("gemini-llm",), "open-ai-api-key": ("open-ai-llm",), "open-ai-model": ("open-ai-llm",),
    "gcp-dlp-built-in-info-type": ("gcp-dlp", "rules"), "gcp-dlp-stored-info-type": ("gcp-dlp",), "gcp-vertex-ai-native-image-support": ("gcp-vertex-ai",),
    "gcp-vertex-ai-block-none-harmful": ("gcp-vertex-ai",),
}
_SPECIAL = {"gcp-dlp-built-in-info-type": "append", "gcp-dlp-stored-info-type": "append", "gcp-vertex-ai-native-image-support": "store_true", "gcp-vertex-ai-block-none-harmful": "store_true"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="umbra")
    sub = p.add_subparsers(dest="command", required=True)
    cp, ls = sub.add_parser("cp", help="copy and redact"), sub.add_parser("ls", help="list")
    for x in (cp, ls):
        x.add_argument("source")
        x.add_argument("-m", "--max-size-limit", type=int)
        x.add_argument("-f", "--filename-filter")
    cp.add_argument("destination")
    cp.add_argument("-n", "--max-files-limit", type=int)
    cp.add_argument("--mime-override", action="append", type=parse_override, default=[])
    cp.add_argument("--save-json-results")
    cp.add_argument("-d", "--redact", action="append")
    cp.add_argument("--allow-unsupported-copies", action="store_true")
    cp.add_argument("--csv-headers-disable", action="store_true")
    cp.add_argument("--csv-delimiter", default=",")
    cp.add_argument("--sampling-size", type=int)
    cp.add_argument("--limit-dlp-requests", type=parse_limit)
    for o in REMOTE_OPTIONS:
        cp.add_argument(f"--{o}", action=_SPECIAL.get(o, "store"))
    return p


def detectors(args: argparse.Namespace) -> list | None:
    """The detectors asked for, each with the options that are its own. An option that none of them takes is refused:
    a run that ignores what it was told to redact is worse than none."""
    given = {o: v for o in REMOTE_OPTIONS if (v := getattr(args, o.replace("-", "_")))}
    for o in given:
        if not set(REMOTE_OPTIONS[o]) & set(args.redact or ()):
            raise ValueError(f"--{o} is for {' or '.join(REMOTE_OPTIONS[o])}, which isn't asked for")
    if args.redact is None:
        if args.limit_dlp_requests or args.allow_unsupported_copies or args.sampling_size:
            raise ValueError("--limit-dlp-requests, --allow-unsupported-copies and --sampling-size need -d")
        return None
    out = []
    for name in args.redact:
        check_options(name, vars(args))
        if name == "rules":
            wanted = set(args.gcp_dlp_built_in_info_type or ())
            if unknown := wanted - {r.entity for r in ALL_RULES}:
                raise ValueError(f"no rule for {', '.join(sorted(unknown))}")
            out.append(RuleDetector([r for r in ALL_RULES if r in DEFAULT_RULES or r.entity in wanted], denied=[d for d in DENIED if d not in wanted]))
        else:
            if name in services.PLAIN and not registered(name):
                services.install(name)
            out.append(detector(name, **{o.replace("-", "_"): v for o, v in given.items() if name in REMOTE_OPTIONS[o]}))
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = session()
        if args.command == "ls":
            files = listing(spark, args.source, args.max_size_limit, args.filename_filter)
            for r in files.filter("verdict = 'Matched'").select("relative_path", "media_type", "file_size").orderBy("relative_path").toLocalIterator():
                print(r["relative_path"], r["media_type"] or "-", "-" if r["file_size"] is None else r["file_size"], sep="\t")
            t = listing_totals(files).first()
            print(f"{t['files_found']} files found, {t['total_size']} bytes, {t['files_skipped']} skipped")
            return 0
        options = CopyOptions(
            args.max_size_limit, args.max_files_limit, args.filename_filter, args.mime_override, detectors(args), args.allow_unsupported_copies,
            not args.csv_headers_disable, args.csv_delimiter, args.sampling_size, args.limit_dlp_requests,
        )
        r = copy(spark, args.source, args.destination, options, args.save_json_results)
        print(f"Finished: {r['files_copied']} copied, {r['files_redacted']} of them redacted, {r['files_skipped']} skipped")
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
