"""What programs import: the functions behind the commands and the single steps. Importing it starts no Spark session."""

from loomspark.cli import as_text, options_of, split_report
from loomspark.cli import run as review_folder
from loomspark.frontend.candidates import detected as split_candidates
from loomspark.frontend.dependencies import graph as dependency_graph
from loomspark.frontend.dependencies import import_cycles, module_edges, overlaid
from loomspark.frontend.nodes import failures, parsed
from loomspark.frontend.outline import chunks, summaries
from loomspark.frontend.rules import complexity_findings, lint_findings, react_findings
from loomspark.frontend.splitting import advised, contract, exports, imports, input_problem, missing_props, placement, problems, props
from loomspark.frontend.targets import allocated as with_targets
from loomspark.functions.text import SEVERITIES
from loomspark.operators.cycles import cycle_paths, cycle_walks, strong_components
from loomspark.operators.findings import any_at_least, at_least, dense_counts, first_of_each, is_valid, ordered
from loomspark.operators.graph import closure, reverse_dependents
from loomspark.operators.intervals import in_scope
from loomspark.plans.code import Options, Review, review
from loomspark.plans.model_review import ChatProvider, ModelReview, Provider, ProviderError, provider
from loomspark.plans.model_review import review as review_by_model
from loomspark.plans.splits import SplitPlan
from loomspark.plans.splits import plan as split_plan
from loomspark.sources.cache import Cache, review_key
from loomspark.sources.changes import changed_files, changed_ranges, diffs, git_root
from loomspark.sources.config import ConfigurationError, exit_code
from loomspark.sources.config import defaults as default_settings
from loomspark.sources.config import load as load_settings
from loomspark.sources.environment import init, logger, probe
from loomspark.sources.files import contents, discovered, listing, single, without_links
from loomspark.sources.transactions import ApplyError, apply, diagnosis, history, lock, rollback

__all__ = [name for name in dir() if not name.startswith("_")]
