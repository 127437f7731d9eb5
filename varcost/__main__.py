"""Command line for the monthly run and its quality gate."""

from __future__ import annotations

import argparse
import json

from varcost.plans.monthly import run_monthly
from varcost.session import get_spark


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="varcost", description=__doc__)
    parser.add_argument("--use-mock", action="store_true", help="use the built-in demo rows")
    parser.add_argument("--landing", help="folder with the raw Parquet tables")
    parser.add_argument("--output", help="warehouse folder")
    parser.add_argument("--format", default="parquet", help="format of the fact table")
    parser.add_argument("--dataset", help="data set of the fact table for other formats")
    parser.add_argument("--database", help="catalogue database whose tables and views show the warehouse")
    parser.add_argument("--output-dq-report", help="where to write the quality report as JSON")
    parser.add_argument(
        "--fail-on-dq-error", action=argparse.BooleanOptionalAction, default=True,
        help="stop before writing if a check fails",
    )
    args = parser.parse_args(argv)
    result = run_monthly(
        get_spark(),
        use_mock=args.use_mock,
        landing=args.landing,
        output=args.output,
        fmt=args.format,
        dataset=args.dataset,
        database=args.database,
        dq_report_path=args.output_dq_report,
        fail_on_dq_error=args.fail_on_dq_error,
    )
    print(json.dumps(result, indent=2, default=str))
    return result


if __name__ == "__main__":
    main()
