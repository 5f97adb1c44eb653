"""SLA compliance and meter power-state analytics on Spark DataFrames."""

from .plans.analysis import SlaAnalysis
from .sources.events import alarms_from_events, imports_from_events, jobs_from_events, load_inputs
from .sources.policy import DEFAULT_POLICY, Tier, TaskPolicy, policy_frame

__all__ = ["SlaAnalysis", "load_inputs", "jobs_from_events", "alarms_from_events", "imports_from_events",
           "DEFAULT_POLICY", "Tier", "TaskPolicy", "policy_frame"]
