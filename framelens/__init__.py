"""framelens: news-narrative analytics on Spark DataFrames.

Ingest landed article files, dedupe and clean them, run batched tactic
inference, similarity-join the corpus, cluster it into events, and score how
far outlets disagree on each event. Everything is a lazy DataFrame plan that
runs on executors; only small aggregates (partition counts, a d x d Gram
matrix, convergence counters) ever reach the driver.
"""

from framelens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
