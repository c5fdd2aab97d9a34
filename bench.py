"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` choose
data and cores.  Every query runs over its whole tables into a sink that
takes all rows; ``setup`` covers a first small query, which starts the Python
workers.
"""

from __future__ import annotations

import json
import os
import time

from catalog import queries, shapes
from hearscore.functions import rates
from hearscore.operators import scoring
from hearscore.plans.evaluate import sample_results
from hearscore.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
NORMS = queries.ALL_NORMS
METRICS = list(rates.METRICS)


def corpus(metrics):
    def query(spark, sf_dir):
        clips = scoring.score_clips(shapes.pairs(spark, sf_dir), NORMS, metrics, tasks=shapes.TASKS)
        return scoring.corpus_metrics(clips, NORMS, metrics)

    return query


def results_table(spark, sf_dir):
    return sample_results(shapes.pairs(spark, sf_dir), NORMS, METRICS, tasks=shapes.TASKS)


HEADLINE = {
    "corpus_wer_6_norms": corpus(["WER"]),
    "corpus_all_metrics_6_norms": corpus(METRICS),
    "per_sample_running_results_6_norms": results_table,
    "norm_fanout": queries.QUERIES["norm_fanout"],
    "norm_all_documents": queries.QUERIES["norm_all"],
    "word_alignment_counts": queries.QUERIES["word_alignment_counts"],
    "corpus_statistics_3_levels": queries.QUERIES["summary_report"],
    "attach_hypotheses": queries.QUERIES["attach_hypotheses"],
    "pending_work": queries.QUERIES["pending_work"],
    "resolve_audio_paths": queries.QUERIES["resolve_audio_paths"],
    "first_n_per_split": queries.QUERIES["first_n_per_split"],
    "seeded_sample_per_split": queries.QUERIES["seeded_sample_per_split"],
    "scan_hyp_cache": queries.QUERIES["scan_hyp_cache"],
    "streaming_scores": queries.QUERIES["streaming_scores"],
}


def run(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    setup = run(corpus(METRICS), spark, small if os.path.isdir(small) else SF_DIR)
    times = {name: run(query, spark, SF_DIR) for name, query in HEADLINE.items()}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "setup": setup,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
