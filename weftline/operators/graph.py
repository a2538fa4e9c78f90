"""The property graph of components, parameters and their edges, from normalised definitions.

Nodes and edges are made as whole sets and brought to one row for each key, which is what upserts one at a time come to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import stem
from weftline.functions.text import expression_references
from weftline.plans.ranking import below

EDGE_KEY = ["rel_type", "src", "dst", "component_id", "step_id", "data_id"]


def node_id(kind: str, component: Column, parameter: Column | None = None) -> Column:
    return F.concat_ws("|", F.lit(kind), component, *([] if parameter is None else [parameter]))


def _in(component: str, parameter: str) -> Column:
    return node_id("InParameter", F.col(component), F.col(parameter))


def _out(component: str, parameter: str) -> Column:
    return node_id("OutParameter", F.col(component), F.col(parameter))


def is_workflow(c: Column) -> Column:
    return F.coalesce(c == "Workflow", F.lit(False))


def resolved_sources(wanted: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds source_node to (workflow_id, source): a source without ``/`` is the workflow's input, ``s/o`` an output of step s's component."""
    called = steps.select("workflow_id", F.col("step_id").alias("source_step"), F.col("run_path").alias("source_component")).dropDuplicates(["workflow_id", "source_step"])
    parts = F.split("source", "/")
    split = wanted.withColumn("source_step", F.when(F.size(parts) > 1, F.get(parts, 0)))
    found = split.join(called, ["workflow_id", "source_step"], "left")
    return found.withColumn("source_node", F.when(F.col("source_step").isNull(), _in("workflow_id", "source")).when(F.col("source_component").isNotNull(), node_id("OutParameter", F.col("source_component"), F.get(parts, 1)))).drop("source_step", "source_component")


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, component: str, step: Column, data: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("rel_type"), src.alias("src"), dst.alias("dst"), F.col(component).alias("component_id"), step.alias("step_id"), data.alias("data_id"))


def tool_edges(params: DataFrame, entities: DataFrame) -> DataFrame:
    """Input -> tool and tool -> output, of everything that is no workflow."""
    tools = params.join(entities.where(~is_workflow(F.col("class"))).select(F.col("path").alias("component_id")), "component_id", "left_semi")
    ins, outs = tools.where("direction = 'in'"), tools.where("direction = 'out'")
    of = node_id("Component", F.col("component_id"))
    return _edge(ins, "DATA_FLOW", _in("component_id", "parameter_id"), of, "component_id", F.lit(""), F.col("parameter_id")).unionByName(_edge(outs, "DATA_FLOW", of, _out("component_id", "parameter_id"), "component_id", F.lit(""), F.col("parameter_id")))


def step_edges(steps: DataFrame, step_inputs: DataFrame) -> DataFrame:
    """What feeds the inputs of each step: the workflow's inputs and the outputs of other steps. Steps defined in place aren't wired."""
    own = steps.where("not is_inline").select("workflow_id", "step_id", "run_path")
    wanted = step_inputs.select("workflow_id", "step_id", "input_id", F.explode("sources").alias("source")).join(own, ["workflow_id", "step_id"])
    found = resolved_sources(wanted, steps).where("source_node is not null")
    return _edge(found, "DATA_FLOW", F.col("source_node"), _in("run_path", "input_id"), "workflow_id", F.col("step_id"), F.col("source"))


def output_edges(params: DataFrame, steps: DataFrame) -> DataFrame:
    """What a workflow's outputs come from."""
    outs = params.where("direction = 'out'").select(F.col("component_id").alias("workflow_id"), "parameter_id", F.explode("sources").alias("source"))
    found = resolved_sources(outs, steps).where("source_node is not null")
    return _edge(found, "DATA_FLOW", F.col("source_node"), _out("workflow_id", "parameter_id"), "workflow_id", F.lit(""), F.col("source"))


def condition_sources(steps: DataFrame, step_inputs: DataFrame, all_references: bool = False) -> DataFrame:
    """workflow_id, step_id, run_path, source: what the condition of each step depends on.

    A parameter stands for that input's sources, or for its own name if the step has no such input. By default a condition that names
    a parameter drops its step outputs, and of several step outputs only the first counts; ``all_references`` keeps all.
    """
    refs = steps.where("when_expr is not null and not is_inline").select("workflow_id", "step_id", "run_path", F.posexplode(expression_references(F.col("when_expr"))).alias("at", "r")).select("workflow_id", "step_id", "run_path", "at", "r.kind", "r.ref")
    if not all_references:
        per = refs.groupBy("workflow_id", "step_id").agg(F.max(F.col("kind") == "parameter").alias("has_parameter"), F.min(F.when(F.col("kind") == "step_output", F.col("at"))).alias("first_output"))
        refs = refs.join(per, ["workflow_id", "step_id"]).where((F.col("kind") == "parameter") | (~F.col("has_parameter") & (F.col("at") == F.col("first_output"))))
    inputs = step_inputs.groupBy("workflow_id", "step_id", F.col("input_id").alias("ref")).agg(F.min_by("sources", "ord").alias("sources"))
    found = refs.join(inputs, ["workflow_id", "step_id", "ref"], "left")
    given = (F.col("kind") == "parameter") & (F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0)
    return found.select("workflow_id", "step_id", "run_path", F.explode(F.when(given, F.col("sources")).otherwise(F.array("ref"))).alias("source")).distinct()


def control_edges(steps: DataFrame, step_inputs: DataFrame, params: DataFrame, all_references: bool = False) -> DataFrame:
    """From every input of a conditional step's component to what the condition depends on."""
    wanted = resolved_sources(condition_sources(steps, step_inputs, all_references), steps).where("source_node is not null")
    ins = params.where("direction = 'in'").select(F.col("component_id").alias("run_path"), "parameter_id").distinct()
    return _edge(wanted.join(ins, "run_path"), "CONTROL_DEPENDENCY", _in("run_path", "parameter_id"), F.col("source_node"), "workflow_id", F.col("step_id"), F.col("source"))


def upserted_edges(candidates: DataFrame) -> DataFrame:
    """One row for each key, with an id made of it."""
    return candidates.dropDuplicates(EDGE_KEY).select(F.concat_ws("|", *EDGE_KEY).alias("edge_id"), *EDGE_KEY, F.lit(None).cast("string").alias("reference"), F.lit(None).cast("array<string>").alias("workflow_list"))


def upserted_parameters(params: DataFrame, entities: DataFrame) -> DataFrame:
    """Parameter nodes: of the types written for a key the last counts, and a write without one clears nothing."""
    classes = entities.select(F.col("path").alias("component_id"), F.col("class").alias("component_type")).dropDuplicates(["component_id"])
    typed = params.join(classes, "component_id", "left")
    both = F.col("parameter_type").isNotNull() & (F.col("parameter_type") != "") & F.col("component_type").isNotNull()
    kind = F.when(F.col("direction") == "in", "InParameter").otherwise("OutParameter")
    nodes = typed.groupBy(kind.alias("kind"), "component_id", "parameter_id").agg(F.max_by(F.when(both, F.struct("parameter_type", "component_type")), F.when(both, F.col("ord"))).alias("t"))
    return nodes.select(F.concat_ws("|", "kind", "component_id", "parameter_id").alias("node_id"), "kind", "component_id", "parameter_id", F.lit(None).cast("string").alias("nice_id"), F.col("t.parameter_type").alias("parameter_type"), F.col("t.component_type").alias("component_type"), F.lit(None).cast("string").alias("git_url"))


def component_nodes(params: DataFrame, entities: DataFrame, sep: str = "/") -> DataFrame:
    """Components: everything with a parameter that is no workflow."""
    null = F.lit(None).cast("string")
    tools = params.select("component_id").distinct().join(entities.where(~is_workflow(F.col("class"))).select(F.col("path").alias("component_id")), "component_id", "left_semi")
    return tools.select(node_id("Component", F.col("component_id")).alias("node_id"), F.lit("Component").alias("kind"), "component_id", null.alias("parameter_id"), stem(F.col("component_id"), sep).alias("nice_id"), null.alias("parameter_type"), null.alias("component_type"), null.alias("git_url"))


def reference_graph(commands: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Git nodes and REFERENCES edges of (component_id, reference, git_url); what no component stands for is dropped."""
    null = F.lit(None).cast("string")
    found = commands.where("git_url is not null").join(components.select("component_id").distinct(), "component_id", "left_semi")
    nodes = found.select("git_url").distinct().select(F.concat_ws("|", F.lit("Git"), "git_url").alias("node_id"), F.lit("Git").alias("kind"), null.alias("component_id"), null.alias("parameter_id"), null.alias("nice_id"), null.alias("parameter_type"), null.alias("component_type"), "git_url")
    edges = found.dropDuplicates(["component_id", "git_url", "reference"]).select(
        F.concat_ws("|", F.lit("REFERENCES"), "component_id", "git_url", "reference").alias("edge_id"), F.lit("REFERENCES").alias("rel_type"), node_id("Component", F.col("component_id")).alias("src"), F.concat_ws("|", F.lit("Git"), "git_url").alias("dst"),
        "component_id", null.alias("step_id"), null.alias("data_id"), "reference", F.lit(None).cast("array<string>").alias("workflow_list"),
    )
    return nodes, edges


def build(entities: DataFrame, params: DataFrame, steps: DataFrame, step_inputs: DataFrame, sep: str = "/", all_references: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of normalised definitions."""
    nodes = component_nodes(params, entities, sep).unionByName(upserted_parameters(params, entities))
    edges = [tool_edges(params, entities), step_edges(steps, step_inputs), output_edges(params, steps), control_edges(steps, step_inputs, params, all_references)]
    return nodes, upserted_edges(reduce(DataFrame.unionByName, edges))


def document_nodes(documents: DataFrame) -> DataFrame:
    """node_id, kind, component_id, component_type of whole definitions whose parameters all have a type: component_id, class, ins, outs."""
    own = F.col("component_id")
    of = lambda kind, p: F.struct(node_id(kind, own, p).alias("node_id"), F.lit(kind).alias("kind"), F.col("class").alias("component_type"))
    tool = F.when(~is_workflow(F.col("class")) & (F.size("ins") + F.size("outs") > 0), F.array(F.struct(node_id("Component", own).alias("node_id"), F.lit("Component").alias("kind"), F.lit(None).cast("string").alias("component_type"))))
    each = F.concat(F.transform("ins", lambda p: of("InParameter", p)), F.transform("outs", lambda o: of("OutParameter", o["parameter_id"])), F.coalesce(tool, F.filter(F.transform("ins", lambda p: of("InParameter", p)), lambda _: F.lit(False))))
    return documents.select("component_id", F.explode(F.array_distinct(each)).alias("n")).select("n.node_id", "n.kind", "component_id", "n.component_type")


def document_edges(documents: DataFrame) -> DataFrame:
    """EDGE_KEY of the data edges of whole definitions, one a row: component_id, class, ins, outs (parameter_id, sources), steps (step_id, run_path, is_inline, inputs (input_id, sources)).

    As tool_edges(), step_edges() and output_edges() together: a step's sources are looked up in its own row.
    """
    own, steps = F.col("component_id"), F.col("steps")

    def node(source: Column) -> Column:
        run = F.get(F.filter(steps, lambda t: t["step_id"] == F.substring_index(source, "/", 1)), F.lit(0))["run_path"]
        return F.when(~source.contains("/"), node_id("InParameter", own, source)).when(run.isNotNull(), node_id("OutParameter", run, F.substring_index(F.substring_index(source, "/", 2), "/", -1)))

    edge = lambda src, dst, step, data: F.struct(src.alias("src"), dst.alias("dst"), step.alias("step_id"), data.alias("data_id"))
    wired = F.flatten(F.transform(F.filter(steps, lambda t: ~t["is_inline"]), lambda t: F.flatten(F.transform(t["inputs"], lambda i: F.transform(i["sources"], lambda s: edge(node(s), node_id("InParameter", t["run_path"], i["input_id"]), t["step_id"], s))))))
    ends = F.flatten(F.transform("outs", lambda o: F.transform(o["sources"], lambda s: edge(node(s), node_id("OutParameter", own, o["parameter_id"]), F.lit(""), s))))
    tool = node_id("Component", own)
    inner = F.concat(F.transform("ins", lambda p: edge(node_id("InParameter", own, p), tool, F.lit(""), p)), F.transform("outs", lambda o: edge(tool, node_id("OutParameter", own, o["parameter_id"]), F.lit(""), o["parameter_id"])))
    every = F.when(is_workflow(F.col("class")), F.concat(wired, ends)).otherwise(F.concat(inner, wired, ends))
    found = documents.select("component_id", F.explode(F.array_distinct(F.filter(every, lambda e: e["src"].isNotNull()))).alias("e"))
    return found.select(F.lit("DATA_FLOW").alias("rel_type"), "e.src", "e.dst", "component_id", "e.step_id", "e.data_id")


def component_ids(nodes: DataFrame) -> DataFrame:
    """Components with an input."""
    return nodes.where("kind = 'InParameter'").select("component_id").distinct()


def workflow_ids(nodes: DataFrame) -> DataFrame:
    """Workflows with an input."""
    return nodes.where("kind = 'InParameter' and component_type = 'Workflow'").select("component_id").distinct()


def details(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """component_id, kind and component_type of the nodes a frontier (node_id) names."""
    return frontier.select("node_id").join(nodes.select("node_id", "component_id", "kind", "component_type"), "node_id")


def control_dependencies(edges: DataFrame) -> DataFrame:
    """src, dst, component_id, edge_id of CONTROL_DEPENDENCY edges."""
    return edges.where("rel_type = 'CONTROL_DEPENDENCY'").select("src", "dst", "component_id", "edge_id")


def lists_from(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """workflow_list of the data edges that leave a frontier's (node_id, component_id) in that component."""
    return frontier.join(edges.where("rel_type = 'DATA_FLOW'").select(F.col("src").alias("node_id"), "component_id", "edge_id", "workflow_list"), ["node_id", "component_id"])


def parameters_of(components: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """node_id and component_type of the parameters, InParameter or OutParameter, of components (component_id)."""
    return components.select("component_id").join(nodes.where(F.col("kind") == kind).select("component_id", "node_id", "component_type"), "component_id")


def valid_connections(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave a frontier's (node_id, component_id, step), in that component; a step admits only data of its outputs."""
    met = frontier.join(edges.withColumnRenamed("src", "node_id"), ["node_id", "component_id"])
    return met.where(F.col("step").isNull() | F.startswith("data_id", F.concat("step", F.lit("/"))))


def outgoing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component_id, edge_id, data_id, dst, dst_component of every edge."""
    to = nodes.select(F.col("node_id").alias("dst"), F.col("component_id").alias("dst_component"))
    return nodes.select("node_id", "kind").join(edges.withColumnRenamed("src", "node_id"), "node_id").join(to, "dst").select("node_id", "component_id", "edge_id", "data_id", "dst", "dst_component")


def outer_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Output parameters that nothing leads to."""
    return nodes.where("kind = 'OutParameter'").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def sizes(nodes: DataFrame, edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """repo, node_count, edge_count by raw prefix, and ``total`` for their sum."""
    p = prefixes.select("repo")
    both = nodes.select("component_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select("component_id", F.lit(0).alias("n"), F.lit(1).alias("e")))
    found = below(both.groupBy("component_id").agg(F.sum("n").alias("n"), F.sum("e").alias("e")), p, "component_id", "repo").select("repo", "n", "e")
    none = p.select("repo", F.lit(0).alias("n"), F.lit(0).alias("e"))
    counted = found.unionByName(none).rollup("repo").agg(F.sum("n").alias("node_count"), F.sum("e").alias("edge_count"))
    return counted.select(F.coalesce("repo", F.lit("total")).alias("repo"), "node_count", "edge_count")


def file_counts(files: DataFrame, repo: str) -> DataFrame:
    """Files by repository, and ``total``."""
    return files.rollup(repo).agg(F.count(F.lit(1)).alias("files")).select(F.coalesce(repo, F.lit("total")).alias("repo"), "files")
