"""The whole way from definition files to scores, as one plan per question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.paths import repo_key
from weftline.operators import closure, coupling, evaluate, flows, graph, history, links
from weftline.plans.lineage import cut
from weftline.sources import definitions, dockerfiles


@dataclass
class Analysis:
    """Tables of one corpus; schemas are in plans.schemas."""

    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame
    entities: DataFrame

    @property
    def component_ids(self) -> DataFrame:
        return graph.component_ids(self.nodes)

    def flows(self) -> DataFrame:
        return flows.flows(self.nodes, self.edges)

    def coupling(self, sep: str = "/") -> DataFrame:
        return coupling.coupling(self.component_ids, cut(self.flows()), sep)

    def scores(self, sep: str = "/") -> DataFrame:
        return coupling.cumulative(coupling.compared(self.component_ids, cut(self.flows()), sep)[1], self.component_ids, sep)

    def sizes(self, sep: str = "/") -> DataFrame:
        repos = self.nodes.select(repo_key(F.col("component_id"), 2, sep).alias("repo")).where("repo is not null").distinct()
        return graph.sizes(self.nodes, self.edges, repos)

    def references(self, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Git nodes and REFERENCES edges of tools, by their commands and scripts, for links (kind, key, git_url)."""
        found = links.base_command_references(self.entities, known).unionByName(links.listing_references(self.entities, known))
        return graph.reference_graph(found, self.nodes.where("kind = 'Component'"))


def analyse(spark: SparkSession, root: str, sep: str = "/", all_references: bool = False) -> Analysis:
    """Scans and parses the definitions below ``root`` and builds the graph, its edges labelled with the workflows that reach them."""
    tables = definitions.tables(cut(definitions.parse(definitions.scan(spark, root, sep=sep), sep)))
    nodes, edges = graph.build(tables["entities"], tables["params"], tables["steps"], tables["step_inputs"], sep, all_references)
    nodes, edges = cut(nodes), cut(edges)
    labelled = cut(closure.label_control_edges(cut(flows.label_reached(nodes, edges))))
    return Analysis(nodes, labelled, tables["errors"], tables["entities"])


def known_links(spark: SparkSession, root: str, repo_files: DataFrame) -> DataFrame:
    """Links of the Dockerfiles below ``root``, given what lies in each repository (repo_url, path)."""
    return links.of_dockerfiles(dockerfiles.read(spark, root), repo_files)


def evaluate_repository(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """The evaluation of coupling (id_1, id_2, score) against commits (id, changed_files), over the ids that both know."""
    changed = history.cochange(history.changes(commits))
    ids = pairs.select(F.explode(F.array("id_1", "id_2")).alias("id")).intersect(changed.select(F.col("file1").alias("id")))
    return evaluate.evaluate(pairs, changed, cut(ids))
