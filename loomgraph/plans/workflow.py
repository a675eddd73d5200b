"""The stages of document-to-graph work, plans over them, and running a plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import json_candidate
from ..functions.text import collapse_space, truncated, uni_trim
from ..sources.tables import written

# ---- fixed values: stages in order, their other names and titles ----
STAGES = ["pdf_to_text", "ontology_draft", "split_strategy", "chunking", "graph_extraction", "exact_cleaning", "semantic_node_merge", "relation_cleaning", "quality_report", "final_graph"]
ALIASES = {
    "upload": "pdf_to_text", "pdf_text_extraction": "pdf_to_text",
    "ontology": "ontology_draft", "ontology_draft_generation": "ontology_draft",
    "strategy": "split_strategy", "split_strategy_analysis": "split_strategy",
    "chunk": "chunking", "text_chunking": "chunking",
    "extract": "graph_extraction", "ontology_instantiation": "graph_extraction",
    "clean": "exact_cleaning", "exact_duplicate_cleaning": "exact_cleaning",
    "merge": "semantic_node_merge", "relationclean": "relation_cleaning",
    "quality": "quality_report", "graph_quality_report": "quality_report",
    "final": "final_graph", "final_graph_generation": "final_graph",
}
TITLES = dict(zip(["文本提取", "本体草案生成", "切分策略选择", "执行切分", "本体实例化", "重复内容清理", "相近节点合并", "关系清洗", "质量报告", "最终图谱生成"], STAGES, strict=True))


# ---- fixed values: texts of plans and contexts ----
FEATURES = {"knowledge-graph": "知识图谱构建"}
GENERAL_STEPS = ["clarify_scope", "process_content", "review_result"]
DEFAULT_STEP, DEFAULT_DESCRIPTION = "步骤 {}", "完成该阶段处理并产出可审核结果。"
DEFAULT_SUMMARY, START_QUESTION = "已根据当前意图生成 workflow，等待用户确认是否开始。", "是否开始这个流程？"
NO_SUMMARY, NO_GOAL = "当前未获取到足够的文档内容，后续将仅基于用户已确认目标进行保守处理。", "基于当前文档构建可审核的知识图谱。"


def identifier(name: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(uni_trim(name)), "[^a-z0-9]+", "_"), r"^_+|_+\z", "")


def stage_of(step_id: Column, title: Column | None = None) -> Column:
    """The stage that a step names by its id, an alias, a skill's key or its title; null if none."""
    known = F.create_map(*[F.lit(x) for pair in {**ALIASES, **{s: s for s in STAGES}}.items() for x in pair])
    found = F.try_element_at(known, identifier(step_id))
    if title is None:
        return found
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.coalesce(found, F.try_element_at(titles, F.regexp_replace(title, r"(?U)[\s\x1c-\x1f]+", "")))


def step_ids(step_id: Column, place: Column) -> Column:
    """Ids that are safe in names of files: of a-z, 0-9, _ and -; step_<place> for those with nothing left."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(uni_trim(step_id)), r"[^a-z0-9_\-]+", "_"), r"^_+|_+\z", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.concat(F.lit("step_"), place.cast("string")))


def normalized_steps(steps: DataFrame) -> DataFrame:
    """Proposed steps (plan_id, pos, id, title, description) with safe ids and defaults; pos from 1."""
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("pos"))
    rows = steps.withColumn("pos", place)
    title = uni_trim(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit(DEFAULT_STEP.format("")), F.col("pos").cast("string"))))
    told = uni_trim(F.coalesce(F.nullif("description", F.lit("")), F.lit(DEFAULT_DESCRIPTION)))
    return rows.select("plan_id", "pos", step_ids(F.col("id"), F.col("pos")).alias("id"), title.alias("title"), told.alias("description"))


def with_fallback(plans: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps of every plan (plan_id, message, feature): those proposed, or else the fallback's.

    The fallback is the ten stages if the feature or the message is about knowledge graphs, else three
    general steps, the second named after the feature.
    """
    own = normalized_steps(steps.join(plans.select("plan_id"), "plan_id", "left_semi"))
    graphs = (F.coalesce("feature", F.lit("")) == "knowledge-graph") | F.coalesce("message", F.lit("")).rlike("知识图谱|抽取")
    stages = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(stage).alias("id"), F.lit(title).alias("title")) for i, (title, stage) in enumerate(TITLES.items())])
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair]), F.col("feature")), F.nullif("feature", F.lit("")))
    titles = [F.lit("确认目标与输入"), F.coalesce(label, F.lit("执行核心处理")), F.lit("审核与确认")]
    general = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(step).alias("id"), titles[i].alias("title")) for i, step in enumerate(GENERAL_STEPS)])
    rest = plans.join(own.select("plan_id").distinct(), "plan_id", "left_anti")
    return own.select("plan_id", "pos", "id", "title").unionByName(rest.select("plan_id", F.inline(F.when(graphs, stages).otherwise(general))))


def context(replies: DataFrame) -> DataFrame:
    """document_summary and user_goal of each request: a reply's if it has both, else from what the request holds.

    replies: reply (JSON or null), message, preview, summary, goal, and further columns that are kept.
    """
    short = lambda c, n: truncated(collapse_space(F.coalesce(c, F.lit(""))), n)
    some = F.from_json(json_candidate(F.col("reply")), "document_summary string, user_goal string")
    told, asked = short(some["document_summary"], 4000), short(some["user_goal"], 1200)
    whole = F.coalesce((told != "") & (asked != ""), F.lit(False))
    first = lambda n, default, *cs: F.coalesce(*[F.nullif(short(F.nullif(c, F.lit("")), n), F.lit("")) for c in cs], F.lit(default))
    goal = F.coalesce(F.nullif("message", F.lit("")), F.col("goal"))
    own = [c for c in replies.columns if c not in ("reply", "message", "preview", "summary", "goal")]
    return replies.select(*own, F.when(whole, told).otherwise(first(1600, NO_SUMMARY, F.col("preview"), F.col("summary"))).alias("document_summary"), F.when(whole, asked).otherwise(first(800, NO_GOAL, goal)).alias("user_goal"))


def validated_plans(steps: DataFrame) -> DataFrame:
    """steps (plan_id, pos, step_id): per plan the number of steps and its first error (null if sound).

    Errors, in this order: a step of no stage, a stage twice, a stage before one that precedes it.
    """
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    rows = steps.withColumn("stage", stage_of(F.col("step_id"))).withColumn("place", place)
    rows = rows.withColumn("before", F.max("place").over(Window.partitionBy("plan_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.groupBy("plan_id").agg(F.count("*").alias("n_steps"), F.count_if(F.col("stage").isNull()).alias("unknown"), (F.count("stage") - F.count_distinct("stage")).alias("twice"), F.count_if(F.col("place") < F.col("before")).alias("disorder"))
    error = F.when(F.col("unknown") > 0, "unknown step").when(F.col("twice") > 0, "duplicate stage").when(F.col("disorder") > 0, "stages out of order")
    return found.select("plan_id", "n_steps", error.alias("error"))


def _stored(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


@dataclass(frozen=True)
class Stage:
    """run gets the context and returns a table, or tables by name."""

    name: str
    run: Callable[[dict], DataFrame | dict[str, DataFrame]]
    needs: tuple[str, ...] = ()


class Workflow:
    """An ordered registry of stages; a run composes the chosen ones and writes each result.

    A stage's function gets the context, a dictionary of options and of the tables made so far, and returns
    a table; options of the caller go before a stage's own defaults. The first failing stage ends a run.
    """

    def __init__(self, stages: list[Stage]):
        self.stages = {s.name: s for s in stages}

    def check(self, names: list[str]) -> list[str]:
        """The stages that names stand for; ValueError for what can't run."""
        if not names:
            raise ValueError("a plan needs steps")
        order, chosen = list(self.stages), []
        for name in names:
            plain = re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")
            stage = ALIASES.get(plain, TITLES.get("".join(name.split()), plain))
            if stage not in self.stages:
                raise ValueError(f"unknown step: {name}")
            if stage in chosen:
                raise ValueError(f"duplicate stage: {stage}")
            if chosen and order.index(stage) < order.index(chosen[-1]):
                raise ValueError(f"stages out of order: {stage} after {chosen[-1]}")
            chosen.append(stage)
        return chosen

    def run(self, spark: SparkSession, names: list[str], context: dict, approved: bool = True, folder: str | None = None) -> tuple[dict, list[dict]]:
        """The context with a table for each stage, and what each step did; tables are written to folder, or to the shared one."""
        if not approved:
            raise ValueError("the plan isn't approved")
        done = []
        for name in self.check(names):
            stage = self.stages[name]
            if missing := [x for x in stage.needs if x not in context]:
                raise ValueError(f"{name} needs {', '.join(missing)}")
            if name not in context:
                table = stage.run(context)
                if folder is None:  # stages are planned one by one either way
                    table = {part: written(df, name) for part, df in table.items()} if isinstance(table, dict) else written(table, name)
                else:
                    table = {part: _stored(spark, df, f"{folder}/{name}/{part}") for part, df in table.items()} if isinstance(table, dict) else _stored(spark, table, f"{folder}/{name}")
                context = {**context, name: table}
            done.append({"stage": name, "success": True, "output_path": f"{folder}/{name}" if folder else None})
        return context, done
