"""The plan of splitting source files: each step stored, so that no later one plans over the whole parse again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loomspark.frontend import candidates, dependencies, splitting, targets
from loomspark.frontend.nodes import failures, parsed
from loomspark.plans.store import written


@dataclass
class SplitPlan:
    candidates: DataFrame
    placement: DataFrame
    contract: DataFrame
    props: DataFrame
    imports: DataFrame
    exports: DataFrame
    problems: DataFrame
    summary: DataFrame
    failures: DataFrame


def plan(files: DataFrame, listing: DataFrame, *, min_lines: int = 20, most: int = 10, target_folder: str | None = None, advice: DataFrame | None = None) -> SplitPlan:
    """files: rel_path, source_text. listing: rel_path of all files of the project. advice: a model's view of the candidates.

    Files that do not parse are in failures and have no candidates.
    """
    files = written(files.select("rel_path", "source_text"), "files")
    nodes = written(parsed(files), "nodes")
    graph = written(dependencies.graph(nodes), "graph")
    found = written(candidates.detected(nodes, min_lines=min_lines, most=most), "candidates")
    if advice is not None:
        found = splitting.advised(found, advice)
    planned = written(targets.allocated(found, target_folder), "targets")
    placed = written(splitting.placement(planned, graph), "placement")
    contract = written(splitting.contract(planned, nodes), "contract")
    return SplitPlan(
        planned, placed, contract, splitting.props(contract), splitting.imports(planned, placed, nodes), splitting.exports(planned, placed, graph),
        splitting.problems(planned, graph, files, listing), splitting.summary(planned, graph, files, nodes, listing), failures(nodes),
    )
