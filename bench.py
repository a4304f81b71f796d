"""Bench: wall seconds of the headline queries at $BENCH_SF_DIR on
local[$BENCH_CPUS]. Prints one JSON line.

Each query is run to completion with the ``noop`` sink (every row computed,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bitext.plans import registry  # noqa: E402
from bitext.session import local_session  # noqa: E402

HEADLINE = [
    "split_corpus",
    "word_counts",
    "bpe_train",
    "bpe_encode",
    "pad_batches",
    "corpus_bleu",
    "corpus_chrf",
    "lexical_em",
    "translate_beam",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    qs = registry.queries()
    # JIT / codegen warm-up on the smallest scale factor (not timed).
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        try:
            qs["split_corpus"](spark, warm_dir).write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001 - warm-up is best effort
            pass
    times, errors = {}, {}
    for name in names:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - report and keep the one-line contract
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total_wall",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                **({"errors": errors} if errors else {}),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
