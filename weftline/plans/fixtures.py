"""The benchmark tables as definitions and commits: orders are workflows and commits, their lines steps, parts tools and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut, sent, shared_dir
from weftline.shipping import ship

#: Brands, at most, that are told by their place among all.
BRANDS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_path():
    return F.concat(F.lit("RD\\"), "p_brand", F.lit("\\steps\\p"), "p_partkey", F.lit(".cwl"))


def order_path(key: str):
    return F.concat(F.lit("RD\\o"), key, F.lit("\\wf.cwl"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_id, file."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))


def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, pos, component_id: the lines of each order in their order, dealt by workflow_id, so that its chains need no second shuffle.

    Where brands are few, a part is sent as its key and the place of its brand, and named where its lines are.
    """
    place = Window.partitionBy("workflow_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("workflow_id", order_path("l_orderkey")).select("workflow_id", "l_partkey", (F.row_number().over(place) - 1).alias("pos"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    found = [r[0] for r in parts.select("p_brand").where("p_brand is not null").distinct().limit(BRANDS + 1).collect()]
    if not 0 < len(found) <= BRANDS:
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("workflow_id", "pos", part_path().alias("component_id"))
    brands = F.array(*(F.lit(b) for b in sorted(found)))
    parts = sent(parts.select("p_partkey", F.coalesce(F.array_position(brands, F.col("p_brand")), F.lit(0)).cast("int").alias("brand")))
    met = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("p_brand", F.get(brands, F.col("brand") - 1))
    return met.select("workflow_id", "pos", part_path().alias("component_id"))


def tool_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(part_path().alias("component_id"))


def definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, params, steps, step_inputs): every part a tool with ``in`` and ``out``, every order a workflow from ``x`` through its steps to ``res``.

    Steps after the first of finished orders have a condition on the first step's output.
    """
    strings = "array<string>"
    chain = cut(chain_steps(spark, sf_dir))  # every table below reads it
    tools, wholes = tool_ids(spark, sf_dir), chain.groupBy("workflow_id").agg(F.max("pos").alias("last"))
    one = lambda df, c, k: df.select(F.col(c).alias("path"), F.lit(k).alias("class"), F.array().cast(strings).alias("base_command"), F.array().cast("array<struct<entryname:string,entry:string>>").alias("listing"))
    entities = one(tools, "component_id", "CommandLineTool").unionByName(one(wholes, "workflow_id", "Workflow"))
    param = lambda df, c, way, name, sources: df.select(F.col(c).alias("component_id"), F.lit(way).alias("direction"), F.lit(name).alias("parameter_id"), F.lit("File").alias("parameter_type"), sources.cast(strings).alias("sources"), F.lit(0).alias("ord"))
    none = F.array()
    params = param(tools, "component_id", "in", "in", none).unionByName(param(tools, "component_id", "out", "out", none)).unionByName(param(wholes, "workflow_id", "in", "x", none))
    params = params.unionByName(param(wholes, "workflow_id", "out", "res", F.array(F.concat(F.lit("s"), "last", F.lit("/out")))))
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(order_path("o_orderkey").alias("workflow_id"), F.lit("$(steps.s0.outputs.out)").alias("condition"))
    step = F.concat(F.lit("s"), F.col("pos").cast("string"))
    steps = chain.join(finished, "workflow_id", "left").select("workflow_id", step.alias("step_id"), F.col("pos").alias("ord"), F.col("component_id").alias("run_path"), F.lit(False).alias("is_inline"), F.when(F.col("pos") > 0, F.col("condition")).alias("when_expr"))
    source = F.when(F.col("pos") == 0, F.lit("x")).otherwise(F.concat(F.lit("s"), (F.col("pos") - 1).cast("string"), F.lit("/out")))
    inputs = chain.select("workflow_id", step.alias("step_id"), F.lit("in").alias("input_id"), F.array(source).alias("sources"), F.lit(0).alias("ord"))
    return entities, params, steps, inputs


def documents(spark: SparkSession, sf_dir: str, steps: bool = True) -> DataFrame:
    """component_id, class, ins, outs, steps: definitions() without conditions as one row for each tool and workflow, dealt by component_id.

    Without ``steps`` workflows have none, and their outputs no sources, so that lines need no order.
    """
    outs, inside = "array<struct<parameter_id:string,sources:array<string>>>", "array<struct<step_id:string,run_path:string,is_inline:boolean,inputs:array<struct<input_id:string,sources:array<string>>>>>"
    out = lambda name, sources: F.array(F.struct(F.lit(name).alias("parameter_id"), sources.cast("array<string>").alias("sources"))).cast(outs)
    one = lambda df, kind, into, outs, steps: df.select("component_id", F.lit(kind).alias("class"), F.array(F.lit(into)).alias("ins"), outs.alias("outs"), steps.cast(inside).alias("steps"))
    tools = one(tool_ids(spark, sf_dir).distinct().repartition("component_id"), "CommandLineTool", "in", out("out", F.array()), F.array())
    if not steps:
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        made = lines.join(sent(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))), "l_partkey", "left_semi").select("l_orderkey").distinct()
        return tools.unionByName(one(made.select(order_path("l_orderkey").alias("component_id")), "Workflow", "x", out("res", F.array()), F.array()))
    chain = chain_steps(spark, sf_dir).groupBy("workflow_id").agg(F.sort_array(F.collect_list(F.struct("pos", "component_id"))).alias("chain"))
    named = lambda pos: F.concat(F.lit("s"), pos.cast("string"))
    source = lambda pos: F.when(pos == 0, F.lit("x")).otherwise(F.concat(named(pos - 1), F.lit("/out")))
    step = F.transform("chain", lambda c: F.struct(named(c["pos"]).alias("step_id"), c["component_id"].alias("run_path"), F.lit(False).alias("is_inline"), F.array(F.struct(F.lit("in").alias("input_id"), F.array(source(c["pos"])).alias("sources"))).alias("inputs")))
    last = F.concat(named(F.array_max("chain.pos")), F.lit("/out"))
    return tools.unionByName(one(chain.where("workflow_id is not null").withColumnRenamed("workflow_id", "component_id"), "Workflow", "x", out("res", F.array(last)), step))


def call_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee: region, nation, customer, order, part."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    of = [
        (t("nation"), node("region", "n_regionkey"), node("nation", "n_nationkey")),
        (t("customer"), node("nation", "c_nationkey"), node("customer", "c_custkey")),
        (t("orders"), node("customer", "o_custkey"), node("order", "o_orderkey")),
        (t("lineitem"), node("order", "l_orderkey"), node("part", "l_partkey")),
    ]
    out = None
    for df, a, b in of:
        one = df.select(a.alias("caller"), b.alias("callee"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee, at: each customer is a workflow that calls the workflows of their urgent pending orders, in their order."""
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    made = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"))
    place = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    numbered = wanted.join(made, "o_orderkey", "left_semi").select("o_custkey", "o_orderkey", (F.row_number().over(place) - 1).alias("at"))
    return numbered.select(F.concat(F.lit("RD\\c"), "o_custkey", F.lit("\\all.cwl")).alias("caller"), order_path("o_orderkey").alias("callee"), "at")


def nested_definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As definitions(), for the orders that nested_calls() names and the customers that call them, each from ``x`` to ``res``."""
    strings, calls = "array<string>", cut(nested_calls(spark, sf_dir))
    entities, params, steps, inputs = definitions(spark, sf_dir)
    inner = calls.select("callee").distinct()
    tools = entities.where("class <> 'Workflow'")
    of = lambda df, c: df.join(inner, F.col(c) == F.col("callee"), "left_semi")
    wholes = calls.groupBy("caller").agg(F.max("at").alias("last"))
    callers = wholes.select(F.col("caller").alias("path"), F.lit("Workflow").alias("class"), F.array().cast(strings).alias("base_command"), F.array().cast("array<struct<entryname:string,entry:string>>").alias("listing"))
    ends = lambda way, name, sources: wholes.select(F.col("caller").alias("component_id"), F.lit(way).alias("direction"), F.lit(name).alias("parameter_id"), F.lit("File").alias("parameter_type"), sources.cast(strings).alias("sources"), F.lit(0).alias("ord"))
    step = F.concat(F.lit("n"), F.col("at").cast("string"))
    calling = calls.select(F.col("caller").alias("workflow_id"), step.alias("step_id"), F.col("at").alias("ord"), F.col("callee").alias("run_path"), F.lit(False).alias("is_inline"), F.lit(None).cast("string").alias("when_expr"))
    source = F.when(F.col("at") == 0, F.lit("x")).otherwise(F.concat(F.lit("n"), (F.col("at") - 1).cast("string"), F.lit("/res")))
    given = calls.select(F.col("caller").alias("workflow_id"), step.alias("step_id"), F.lit("x").alias("input_id"), F.array(source).alias("sources"), F.lit(0).alias("ord"))
    of_tools = params.join(tools.select(F.col("path").alias("component_id")), "component_id", "left_semi")
    return (
        tools.unionByName(of(entities, "path")).unionByName(callers),
        of_tools.unionByName(of(params, "component_id")).unionByName(ends("in", "x", F.array())).unionByName(ends("out", "res", F.array(F.concat(F.lit("n"), "last", F.lit("/res"))))),
        of(steps, "workflow_id").withColumn("when_expr", F.lit(None).cast("string")).unionByName(calling),
        of(inputs, "workflow_id").unionByName(given),
    )


def definition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a tool of each part; a workflow of each supplier, with a step that calls a part and one defined in place; and what is no mapping."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    tool = F.concat(F.lit("class: CommandLineTool\nbaseCommand: [run.py, p"), "p_partkey", F.lit("]\ninputs:\n  in: File\n  size: {type: ['null', int]}\noutputs:\n- {id: out, type: {type: array, items: File}}\n"))
    calls = F.concat(
        F.lit("class: Workflow\ninputs:\n- {id: x, type: File}\noutputs:\n  res: {type: File, outputSource: b/out}\nsteps:\n- id: a\n  run: ../tools/./p"), "s_suppkey",
        F.lit(".cwl\n  in: [{id: in, source: x}, {id: size, source: [x, x]}]\n  when: $(inputs.size)\n- id: b\n  run: {class: ExpressionTool, inputs: {in: File}, outputs: {out: File}, baseCommand: echo}\n  in: {in: a/out}\n"),
    )
    rows = part.select(F.concat(F.lit("RD/tools/p"), "p_partkey", F.lit(".cwl")).alias("path"), tool.alias("content"))
    rows = rows.unionByName(supplier.select(F.concat(F.lit("RD/s"), "s_suppkey", F.lit("/wf.cwl")).alias("path"), calls.alias("content")))
    rows = rows.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("RD/bad/r"), "r_regionkey", F.lit(".cwl")).alias("path"), F.concat(F.lit("- "), "r_name").alias("content")))
    return rows.select("path", F.encode("content", "UTF-8").alias("content"))


def write_files(spark: SparkSession, files: list[tuple[str, str]]) -> str:
    """A new folder below the shared one with the given (path, text) files, written through Spark's file systems."""
    root = f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in files:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    return root


def nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a tool and a Dockerfile for each nation; there are 25 whatever the scale."""
    files = []
    for k, r in sorted((n["n_nationkey"], n["n_regionkey"]) for n in table(spark, sf_dir, "nation").collect()):
        command = f"[x{k}.py, -v]" if r % 2 else f"[n{k}]"
        files.append((f"g/r{r}/t{k}.cwl", f"class: CommandLineTool\nbaseCommand: {command}\ninputs: {{in: File}}\noutputs: {{out: File}}\n"))
        clone = f"git clone https://h/g/n{k}.git /opt/n{k} && ln -s /opt/n{k}/x{k}.py /usr/local/bin/x{k}.py" if r % 2 else f"git clone --no-checkout https://h/g/n{k}.git"
        files.append((f"g/r{r}/n{k}/Dockerfile", f"FROM base\nRUN apt update && \\\n  {clone}\n"))
    return write_files(spark, files)
