"""``python -m lineweave``: a pipeline over files, to standard output; exit codes as grep has them."""

from __future__ import annotations

import argparse
import sys

from . import spec, testing
from .library import LibraryError

# Exit codes.
OK, NO_MATCH, USAGE, CONFIG, PATTERN, IO, INVALID = range(7)


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser("lineweave")
    a.add_argument("-c", "--config")
    a.add_argument("-p", "--pattern")
    a.add_argument("-r", "--replacement")
    a.add_argument("--extract", action="store_true")
    a.add_argument("--transform")
    a.add_argument("--preset", choices=sorted([*spec.PRESETS, *spec.PRESET_ALIASES]))
    for name in ("count", "explain", "lint", "validate", "test", "stats", "json", "line-numbers"):
        a.add_argument(f"--{name}", action="store_true")
    a.add_argument("paths", nargs="*")
    o = a.parse_args(argv)
    try:
        p = spec.load(o.config) if o.config else spec.preset(o.preset) if o.preset else spec.inline(o.pattern, o.replacement, o.extract, o.transform) if o.pattern else None
    except OSError as e:
        print(e, file=sys.stderr)
        return IO
    except (ValueError, LibraryError) as e:
        print(e, file=sys.stderr)
        return CONFIG
    if p is None:
        a.print_usage(sys.stderr)
        return USAGE
    found = spec.problems(p)
    if o.validate or found:
        print("\n".join(found) or "valid", file=sys.stderr if found else sys.stdout)
        return INVALID if found else OK
    if o.explain or o.lint:
        print("\n".join(spec.explain(p) if o.explain else spec.lint(p)))
        return OK
    try:
        [s.compiled(s.pattern, p.settings).java for s in p.steps]
    except Exception as e:  # noqa: BLE001 - whatever the pattern's engine says
        print(e, file=sys.stderr)
        return PATTERN
    from pyspark.sql import SparkSession

    from .engine import finalize, run
    from .plans import ship
    from .sources import sinks
    from .sources.lines import discover, read_lines

    spark = ship(SparkSession.builder.appName("lineweave").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    if o.test:
        done = testing.run_tests(spark, p)
        print(testing.text_report(done))
        return OK if all(x.passed for x in done) else INVALID
    files, errors = discover(o.paths)
    for e in errors:
        print(e, file=sys.stderr)
    if not files:
        return IO if errors else USAGE
    r = run(p, read_lines(spark, [f"file://{f}" if f.startswith("/") else f for f in files]), stats=o.stats or p.finalize is not None)
    lines = sinks.numbered(r.lines) if o.line_numbers else r.lines
    n = 0
    if p.finalize and p.finalize.suppress_output:
        n = r.lines.limit(1).count()
    elif o.count:
        for row in lines.groupBy("source").count().orderBy("source").toLocalIterator():
            n += row["count"]
            print(f"{row['source']}:{row['count']}")
    else:
        for row in lines.orderBy("source", "line_no").toLocalIterator():
            n += 1
            print(row.value if not o.json else sinks.envelope("processing", {"source": row.source, "line": row.line_no, "text": row.value}))
    if p.finalize and (summary := finalize(p, r)):
        print(summary)
    if o.stats:
        for row in r.stats.orderBy("step_index").collect():
            print(row.asDict(), file=sys.stderr)
    return OK if n else NO_MATCH


if __name__ == "__main__":
    sys.exit(main())
