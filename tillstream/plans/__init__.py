"""The job and the registered queries."""

from tillstream.plans.job import run_job, start_job, start_queries, wait_for_any

__all__ = ["run_job", "start_job", "start_queries", "wait_for_any"]
