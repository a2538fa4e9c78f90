"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _of(**columns) -> StructType:
    return StructType([StructField(k, v) for k, v in columns.items()])


S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()  # noqa: E741

NODES = _of(node_id=S, kind=S, component_id=S, parameter_id=S, nice_id=S, parameter_type=S, component_type=S, git_url=S)
EDGES = _of(edge_id=S, rel_type=S, src=S, dst=S, component_id=S, step_id=S, data_id=S, reference=S, workflow_list=ArrayType(S))
ENTITIES = _of(path=S, **{"class": S}, base_command=ArrayType(S), listing=ArrayType(_of(entryname=S, entry=S)))
PARAMS = _of(component_id=S, direction=S, parameter_id=S, parameter_type=S, sources=ArrayType(S), ord=I)
STEPS = _of(workflow_id=S, step_id=S, ord=I, run_path=S, is_inline=B, when_expr=S)
STEP_INPUTS = _of(workflow_id=S, step_id=S, input_id=S, sources=ArrayType(S), ord=I)
FLOWS = _of(source_id=S, target_id=S, context_id=S, flow_type=S, distance=I)
COUPLING = _of(id_1=S, id_2=S, score=D)
COMMITS = _of(id=S, changed_files=ArrayType(S))
COCHANGE = _of(file1=S, file2=S, co=L, pct=D)
LINKS = _of(kind=S, key=S, git_url=S)
REPO_FILES = _of(repo_url=S, path=S)
MR_COMMITS = _of(project_id=S, mr_id=S, commit_id=S, message=S, new_path=S)
