"""Time the registered queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or "all"; default the headline list below).
Each query is planned and fully computed once; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barweave.plans import registry  # noqa: E402
from barweave.session import build_session  # noqa: E402


HEADLINE = (
    "log_returns", "momentum", "frac_diff", "vol_close", "vol_yang_zhang", "feature_frame",
    "cs_rank", "cs_zscore", "sector_neutral", "last_bar_asof", "triple_barrier",
    "tsmom", "xsmom", "quality", "ou", "pairs_zscore", "ic_spearman",
    "constrained", "cov_pairs", "ledoit_wolf", "risk_contrib",
    "strategy_performance", "ledger", "equity_curve",
    "performance", "drawdowns", "var_cornish_fisher", "expected_shortfall", "stress", "audit",
    "rolling_sharpe_beta", "factor_beta", "cpcv_sharpes", "bootstrap_ci",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    queries = registry.queries()
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed action starts the JVM's and Python workers' machinery.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    names = list(queries) if chosen == ["all"] else chosen or HEADLINE
    for name in names:
        start = time.perf_counter()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # a failure is reported, not hidden in the total
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds" if not chosen else "query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "failed": failed,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
