"""Definitions to graph to flows to coupling, on hand-made and random graphs."""

import json
import random
from collections import Counter

import pytest
import yaml
from pyspark.sql import functions as F

from tests import model
from weftline.operators import closure, coupling, flows, graph
from weftline.plans.lineage import cut
from weftline.sources import definitions, dockerfiles, files

TOOL = {"class": "CommandLineTool", "inputs": [{"id": "in", "type": "File"}], "outputs": [{"id": "out", "type": "File"}], "baseCommand": "run.py"}
GOLDEN = {
    "wf.cwl": {
        "class": "Workflow",
        "inputs": [{"id": "x", "type": "File"}, {"id": "flag", "type": "boolean"}],
        "outputs": [{"id": "res", "type": "File", "outputSource": "c/out"}],
        "steps": [
            {"id": "a", "run": "A.cwl", "in": [{"id": "in", "source": "x"}], "out": ["out"]},
            {"id": "b", "run": "S.cwl", "in": [{"id": "y", "source": "a/out"}], "out": ["out"]},
            {"id": "c", "run": "C.cwl", "in": [{"id": "in", "source": "b/out"}], "out": ["out"], "when": "$(inputs.flag)"},
        ],
    },
    "S.cwl": {
        "class": "Workflow",
        "inputs": {"y": "File"},
        "outputs": {"out": {"type": "File", "outputSource": "u/out"}},
        "steps": [
            {"id": "t", "run": "./x/../T.cwl", "in": [{"id": "in", "source": "y"}], "out": ["out"]},
            {"id": "u", "run": "U.cwl", "in": {"in": "t/out"}, "out": ["out"]},
        ],
    },
    "A.cwl": TOOL, "C.cwl": TOOL, "T.cwl": {**TOOL, "inputs": {"in": {"type": ["null", "File"]}}}, "U.cwl": TOOL,
}


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repos") / "g" / "r"
    root.mkdir(parents=True)
    for name, entity in GOLDEN.items():
        (root / name).write_text(yaml.safe_dump(entity, sort_keys=False))
    (root / "broken.cwl").write_text("a: [")
    (root / "latin.cwl").write_bytes("class: CommandLineTool\ndoc: caf\xe9\n".encode("latin-1"))
    parsed = cut(definitions.parse(definitions.scan(spark, str(root.parents[1]))))
    t = definitions.tables(parsed)
    nodes, edges = graph.build(t["entities"], t["params"], t["steps"], t["step_inputs"])
    return t, cut(nodes), cut(edges)


def short(x):
    return x.split("/")[-1].removesuffix(".cwl")


def test_parsed(golden):
    t, _, _ = golden
    assert [r["path"] for r in t["errors"].collect()] == ["g/r/broken.cwl"]
    assert t["entities"].count() == 7
    assert {r["base_command"][0] for r in t["entities"].where("class = 'CommandLineTool' and size(base_command) > 0").collect()} == {"run.py"}


def test_nodes_and_edges(golden):
    _, nodes, edges = golden
    assert Counter(r["kind"] for r in nodes.collect()) == {"InParameter": 7, "OutParameter": 6, "Component": 4}
    assert Counter(r["rel_type"] for r in edges.collect()) == {"DATA_FLOW": 15, "CONTROL_DEPENDENCY": 1}
    control = edges.where("rel_type = 'CONTROL_DEPENDENCY'").first()
    assert (control["src"], control["dst"], control["step_id"], control["data_id"]) == ("InParameter|g/r/C.cwl|in", "InParameter|g/r/wf.cwl|flag", "c", "flag")
    assert nodes.where("node_id = 'InParameter|g/r/T.cwl|in'").first()["parameter_type"] == "null OR File"


def test_labels(golden):
    _, nodes, edges = golden
    workflows = graph.workflow_ids(nodes)
    inputs = nodes.where("kind = 'InParameter' and component_type = 'Workflow'").select("component_id", "node_id")
    calls = closure.call_edges(edges, inputs)
    assert [(short(r[0]), short(r[1])) for r in calls.collect()] == [("wf", "S")]
    every = edges.join(nodes.select(F.col("node_id").alias("dst"), F.col("component_id").alias("callee")), "dst").where("rel_type = 'DATA_FLOW' and component_id <> callee").select(F.col("component_id").alias("caller"), "callee").distinct()
    labelled = closure.label_control_edges(closure.label_edges(edges, closure.ancestors(every), workflows))
    for r in labelled.collect():
        if r["rel_type"] == "CONTROL_DEPENDENCY":
            assert r["workflow_list"] is None  # nothing of wf leaves wf.flag
        else:
            wanted = ["wf"] if short(r["component_id"]) in ("wf", "A", "C") else ["S", "wf"]
            assert [short(w) for w in r["workflow_list"]] == wanted
    assert {r["edge_id"]: r["workflow_list"] for r in flows.label_reached(nodes, edges).where("rel_type = 'DATA_FLOW'").collect()} == {r["edge_id"]: r["workflow_list"] for r in labelled.where("rel_type = 'DATA_FLOW'").collect()}
    assert closure.call_edges(labelled, inputs, labelled=True).count() == 1 and closure.call_edges(edges, inputs, labelled=True).count() == 0
    assert [short(r["node"]) for r in closure.order(calls, workflows.withColumnRenamed("component_id", "node")).collect()] == ["wf", "S"]


def test_golden_flows_and_coupling(golden):
    _, nodes, edges = golden
    rows = [(short(r[0]), short(r[1]), short(r[2]), r[3], r[4]) for r in flows.flows(nodes, edges).collect()]
    wanted = [(o, c, o, "Direct", 1) for o, cs in (("wf", "ASTUC"), ("S", "TU")) for c in cs] + [(c, o, o, "Indirect", 1) for o, cs in (("wf", "ATUSC"), ("S", "TU")) for c in cs]
    wanted += [("T", "U", "wf", "Sequential", 1), ("U", "C", "wf", "Sequential", 1), ("S", "C", "wf", "Sequential", 1), ("T", "C", "wf", "Transitive", 2)]
    assert Counter(rows) == Counter(wanted)
    scores = coupling.coupling(graph.component_ids(nodes), flows.flows(nodes, edges), sep="/")
    found = {frozenset((short(r[0]), short(r[1]))): r[2] for r in scores.collect()}
    pairs = {"A-wf": 2, "C-wf": 2, "S-wf": 2, "T-wf": 2, "U-wf": 2, "S-T": 2, "S-U": 2, "T-U": 1, "C-S": 1, "C-U": 1, "C-T": 0.5, "A-C": 0, "A-S": 0, "A-T": 0, "A-U": 0}
    assert found == {frozenset(k.split("-")): float(v) for k, v in pairs.items()}
    sums = {short(r["file"]): r["score"] for r in coupling.cumulative(scores, graph.component_ids(nodes), sep="/").collect()}
    assert sums == {"A": 2, "C": 4.5, "S": 7, "T": 5.5, "U": 6, "wf": 10}


def test_analysis(spark, tmp_path):
    from weftline.plans import analysis

    root = tmp_path / "g" / "r"
    root.mkdir(parents=True)
    for name, entity in GOLDEN.items():
        (root / name).write_text(yaml.safe_dump(entity))
    (root / "Dockerfile").write_text("FROM x\nRUN git clone https://h/g/t.git /usr/local/bin\n")
    a = analysis.analyse(spark, str(tmp_path))
    assert {short(r["file"]): r["score"] for r in a.scores().collect()} == {"A": 2, "C": 4.5, "S": 7, "T": 5.5, "U": 6, "wf": 10}
    assert {r["repo"]: (r["node_count"], r["edge_count"]) for r in a.sizes().collect()} == {"g/r": (17, 16), "total": (17, 16)}
    known = analysis.known_links(spark, str(tmp_path), spark.createDataFrame([("https://h/g/t.git", "run.py")], "repo_url string, path string"))
    nodes, edges = a.references(known)
    assert nodes.count() == 1 and {short(r["component_id"]) for r in edges.collect()} == {"A", "C", "T", "U"}
    commits = spark.createDataFrame([(str(i), [f"g/r/{x}.cwl" for x in c]) for i, c in enumerate(("AC", "TU", "ST", "TU"))], "id string, changed_files array<string>")
    r = analysis.evaluate_repository(cut(a.coupling()), commits).first()
    assert r["u_n1"] + r["u_n0"] == 20 and r["tau_n"] == 25


def test_labels_follow_calls(spark):
    """A tool's input that only one of two workflows wires is labelled with that one."""
    t = ("t", "CommandLineTool")
    nodes = [("InParameter|t|a", "InParameter", *t), ("InParameter|t|b", "InParameter", *t), ("Component|t", "Component", "t", None), ("OutParameter|t|o", "OutParameter", *t)]
    edges = [("InParameter|t|a", "Component|t", "t", "", "a"), ("InParameter|t|b", "Component|t", "t", "", "b"), ("Component|t", "OutParameter|t|o", "t", "", "o")]
    for w, ps in (("v", "a"), ("w", "ab")):
        nodes += [(f"InParameter|{w}|x", "InParameter", w, "Workflow")]
        edges += [(f"InParameter|{w}|x", f"InParameter|t|{p}", w, "s", "x") for p in ps]
    n = spark.createDataFrame(nodes, "node_id string, kind string, component_id string, component_type string")
    e = spark.createDataFrame([("DATA_FLOW", *x, None) for x in edges], "rel_type string, src string, dst string, component_id string, step_id string, data_id string, workflow_list array<string>")
    got = {(r["src"], r["dst"]): r["workflow_list"] for r in flows.label_reached(n, e).collect()}
    assert got["InParameter|t|a", "Component|t"] == ["v", "w"] and got["InParameter|t|b", "Component|t"] == ["w"] and got["Component|t", "OutParameter|t|o"] == ["v", "w"]


def random_graph(seed):
    """Nested workflows over tools with one or two inputs: (nodes, edges)."""
    rng = random.Random(seed)
    nodes, edges = {}, set()
    of = lambda c, p, kind: f"{kind}|{c}|{p}"
    tools = [f"t{i}" for i in range(3)]
    inputs = {t: ["in"] + ["in2"] * rng.randint(0, 1) for t in tools}
    for t in tools:
        nodes[f"Component|{t}"] = ("Component", t, "")
        nodes[of(t, "out", "OutParameter")] = ("OutParameter", t, "CommandLineTool")
        edges.add((f"Component|{t}", of(t, "out", "OutParameter"), t, "", "out"))
        for p in inputs[t]:
            nodes[of(t, p, "InParameter")] = ("InParameter", t, "CommandLineTool")
            edges.add((of(t, p, "InParameter"), f"Component|{t}", t, "", p))
    callable_ = list(tools)
    workflows = [f"w{i}" for i in range(rng.randint(1, 4))]
    for w in reversed(workflows):
        inputs[w] = ["x", "z"][: rng.randint(1, 2)]
        for p in inputs[w]:
            nodes[of(w, p, "InParameter")] = ("InParameter", w, "Workflow")
        nodes[of(w, "out", "OutParameter")] = ("OutParameter", w, "Workflow")
        sources = [(of(w, p, "InParameter"), p) for p in inputs[w]]
        for i in range(rng.randint(1, 3)):
            c = rng.choice(callable_)
            for p in inputs[c]:
                src, data = rng.choice(sources)
                edges.add((src, of(c, p, "InParameter"), w, f"s{i}", data))
            sources.append((of(c, "out", "OutParameter"), f"s{i}/out"))
        src, data = rng.choice(sources)
        edges.add((src, of(w, "out", "OutParameter"), w, "", data))
        callable_.append(w)
    return nodes, edges


def levels_of(nodes, edges):
    calls = {(c, nodes[d][1]) for _, d, c, _, _ in edges if nodes[d][2] == "Workflow" and nodes[d][0] == "InParameter" and nodes[d][1] != c}
    workflows = {v[1] for v in nodes.values() if v[2] == "Workflow"}
    level = {w: 0 for w in workflows}
    for _ in workflows:
        for a, b in calls:
            level[b] = max(level[b], level[a] + 1)
    return sorted(workflows, key=lambda w: (level[w], w))


def many_graphs(seeds):
    """Several random graphs with shared tools as one."""
    nodes, edges = {}, set()
    for seed in seeds:
        n, e = random_graph(seed)
        new = lambda x, seed=seed: "|".join(f"g{seed}.{p}" if p[:1] == "w" and p[1:].isdigit() else p for p in x.split("|"))
        nodes |= {new(k): (a, new(b), c) for k, (a, b, c) in n.items()}
        edges |= {(new(a), new(b), new(c), s, x) for a, b, c, s, x in e}
    return nodes, edges


@pytest.mark.parametrize("seeds", [[3], range(60)])
def test_traversal_equals_model(spark, seeds):
    """Lanes that share tools, and lanes of called workflows, agree with one traversal of everything, state by state."""
    nodes, edges = many_graphs(seeds)
    wanted = model.flows(nodes, edges, levels_of(nodes, edges))
    n = spark.createDataFrame([(k, a, b, c or None) for k, (a, b, c) in nodes.items()], "node_id string, kind string, component_id string, component_type string")
    e = spark.createDataFrame([("DATA_FLOW", *x) for x in edges], "rel_type string, src string, dst string, component_id string, step_id string, data_id string")
    assert Counter(tuple(r) for r in flows.flows(n, e).collect()) == wanted


def test_cycle(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "caller string, callee string")
    nodes = calls.select(F.col("caller").alias("node"))
    with pytest.raises(closure.CycleError):
        closure.levels(calls, nodes)
    with pytest.raises(closure.CycleError):
        closure.levels(calls.where("caller <> 'a'"), nodes.where("node <> 'a'"))


def test_conditions(spark):
    steps = spark.createDataFrame([("w", "s", 0, "t", False, "$(inputs.a && steps.p.outputs.o && steps.q.outputs.o)"), ("w", "u", 1, "t", False, "$(steps.p.outputs.o && steps.q.outputs.o)")], "workflow_id string, step_id string, ord int, run_path string, is_inline boolean, when_expr string")
    inputs = spark.createDataFrame([("w", "s", "a", ["x", "p/o"], 0)], "workflow_id string, step_id string, input_id string, sources array<string>, ord int")
    found = lambda **k: sorted((r["step_id"], r["source"]) for r in graph.condition_sources(steps, inputs, **k).collect())
    assert found() == [("s", "p/o"), ("s", "x"), ("u", "p/o")]
    assert found(all_references=True) == [("s", "p/o"), ("s", "q/o"), ("s", "x"), ("u", "p/o"), ("u", "q/o")]


def test_references(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "Dockerfile.x").write_text("FROM a\nRUN git clone https://h/g/r.git /opt/r && \\\n  ln -s /opt/r/x.py /usr/local/bin/x.py\nRUN git clone --no-checkout https://h/g/n.git\n")
    docker = dockerfiles.read(spark, str(tmp_path))
    from weftline.operators import links

    listed = spark.createDataFrame([("https://h/g/r.git", "x.py"), ("https://h/g/r.git", "lib/y.py")], "repo_url string, path string")
    known = links.of_dockerfiles(docker, listed)
    assert sorted(tuple(r) for r in known.collect()) == [("commands", "n", "https://h/g/n.git"), ("paths", "/opt/r/lib/y.py", "https://h/g/r.git"), ("paths", "/opt/r/x.py", "https://h/g/r.git"), ("paths", "/usr/local/bin/x.py", "https://h/g/r.git")]
    entities = spark.createDataFrame(
        [("t1", "CommandLineTool", ["x.py", "-v"], []), ("t2", "CommandLineTool", ["n"], []), ("t3", "CommandLineTool", ["go.sh"], [("go.sh", "python /opt/r/lib/y.py | n")]), ("t4", "CommandLineTool", ["y.py"], [])],
        "path string, class string, base_command array<string>, listing array<struct<entryname:string,entry:string>>",
    )
    base = links.base_command_references(entities, known)
    assert sorted(tuple(r) for r in base.collect()) == [("t1", "x.py -v", "https://h/g/r.git"), ("t2", "n", "https://h/g/n.git")]
    assert sorted((r[0], r[2]) for r in links.listing_references(entities, known).collect()) == [("t3", "https://h/g/n.git")]  # no word boundary stands before a leading slash
    nodes, edges = graph.reference_graph(base, spark.createDataFrame([("t1",)], "component_id string"))
    assert nodes.count() == 1 and edges.first()["src"] == "Component|t1"


def test_files(spark, tmp_path):
    rows = [("a", "b", "w", "Direct", 1), ("a", "b", "w", "Direct", 1), ("b", "c", "w", "Transitive", 2)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, context_id string, flow_type string, distance int")
    assert {r["source_id"]: len(r["targets"]) for r in flows.nested(df).collect()} == {"a": 1, "b": 1}
    (tmp_path / "flows.json").write_text(json.dumps({"a": {"b": [["w", "Direct", 1], ["w", "Direct", 1]]}, "b": {"c": [["w", "Transitive", 2]]}}))
    assert Counter(tuple(r) for r in files.read_flows(spark, str(tmp_path / "flows.json")).collect()) == Counter(rows)
    (tmp_path / "commits.json").write_text(json.dumps([{"id": "1", "changed_files": ["a.cwl", "b.cwl"]}]))
    assert files.read_commits(spark, str(tmp_path / "commits.json")).first()["changed_files"] == ["a.cwl", "b.cwl"]
    from weftline.operators import matrix

    pairs = spark.createDataFrame([("a", "b", 2.5), ("b", "c", 0.0)], "id_1 string, id_2 string, score double")
    files.write_matrix(matrix.pivoted(pairs, "id_1", "id_2", "score", ["a", "b", "c"]), str(tmp_path / "m"))
    back = {(r[0], r[1]): r[2] for r in files.read_matrix(spark, str(tmp_path / "m")).collect()}
    assert back["a", "b"] == back["b", "a"] == 2.5 and back["a", "c"] == back["a", "a"] == -1 and len(back) == 9
    assert json.loads(files.scores_json(spark.createDataFrame([("r", "a", 1.5)], "repo string, file string, score double")).first()["json"]) == {"a": 1.5}


@pytest.mark.parametrize("name,walk", [("q_flow_traversal", "flows"), ("q_reached_workflow_list", "label_reached")])
def test_traversal_is_given_data_edges_only(spark, data, monkeypatch, name, walk):
    """Control edges, which no traversal walks, are neither made nor kept for it."""
    given = []
    real = getattr(flows, walk)
    monkeypatch.setattr(flows, walk, lambda nodes, edges: given.append((nodes, edges)) or real(nodes.limit(0), edges.limit(0)))
    from weftline import catalog

    catalog.QUERIES[name](spark, data)
    (nodes, edges) = given[0]
    assert {r[0] for r in edges.select("rel_type").distinct().collect()} == {"DATA_FLOW"}
    assert set(nodes.columns) == {"node_id", "kind", "component_id", "component_type"}


@pytest.mark.parametrize("name", ["q_flow_traversal", "q_reached_workflow_list"])
def test_simple_lanes_need_no_rounds(spark, data, monkeypatch, name):
    """Workflows that lead along one way are followed inside their own rows."""
    from weftline import catalog

    monkeypatch.setattr(flows, "_walk", lambda *_, **__: pytest.fail("walked in rounds"))
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_documents_make_the_same_graph(spark, data):
    """Whole definitions give the data edges and nodes that the tables of their parts give."""
    from weftline.plans import fixtures

    nodes, edges = graph.build(*fixtures.definitions(spark, data), "\\")
    wanted = edges.where("rel_type = 'DATA_FLOW'").select(*graph.EDGE_KEY)
    assert Counter(tuple(r) for r in graph.document_edges(fixtures.documents(spark, data)).collect()) == Counter(tuple(r) for r in wanted.collect())
    columns = ["node_id", "kind", "component_id", "component_type"]
    assert Counter(tuple(r) for r in graph.document_nodes(fixtures.documents(spark, data, steps=False)).select(columns).collect()) == Counter(tuple(r) for r in nodes.select(columns).collect())
