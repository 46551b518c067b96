"""One question from plan to result, and the evaluation of many: the driver's control flow around the batch operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.operators import metrics, reports, retrieval
from loamweave.operators.context import MODES
from loamweave.plans.planner import Context, Plan, Planner, report_terms
from loamweave.sources import files, report_store

REBUILD = "build-community-reports"
PLAN = "query_id long, query string, entities array<string>, vectors array<array<float>>, context_mode string, page_types array<string>"


@dataclass
class Result:
    query: str
    plan: Plan
    status: str | None = None
    reasons: list[str] = field(default_factory=list)
    action: str | None = None
    fallback: bool = False
    warning: str | None = None
    items: list[dict] = field(default_factory=list)
    markdown: str = ""
    budget: dict = field(default_factory=dict)
    omitted: list[dict] = field(default_factory=list)
    n_graph: int = 0

    def exit_code(self) -> int:
        return retrieval.exit_code(self.status, self.fallback, sum(1 for i in self.items if not i.get("embed")))

    def to_json(self) -> str:
        images = [i for i in self.items if i.get("embed")]
        return json.dumps({
            "query": self.query, "query_plan": json.loads(self.plan.to_json()), "status": self.status, "stale_reasons": self.reasons, "required_action": self.action, "local_fallback_used": self.fallback,
            "confidence_warning": self.warning, **self.budget, "text": [i for i in self.items if not i.get("embed")], "images": images, "omitted": self.omitted,
        }, ensure_ascii=False, sort_keys=True)


def plan_rows(spark: SparkSession, plans: list[Plan], embed: Callable[[list[str]], list] | None) -> DataFrame:
    """Plans as rows of the batch operators, numbered from 0; without ``embed`` they have no vectors."""
    rows = []
    for n, p in enumerate(plans):
        vectors = [[float(x) for x in v] for v in embed(list(p.semantic_queries))] if embed else []
        rows.append((n, p.search_terms(), list(p.entities), vectors, p.context_mode, list(p.page_types)))
    return spark.createDataFrame(rows, PLAN)


def report_gate(spark: SparkSession, root: str | None, members: DataFrame | None, pages: DataFrame | None, edges: DataFrame | None) -> tuple[str, list[str], DataFrame | None]:
    """(status, reasons, reports) of the active set of reports against the graph as it is."""
    active = report_store.read_active(spark, root) if root else None
    if active is None:
        return "missing", ["no active set"], None
    made, manifest = active
    if manifest["stale_at"]:
        return "stale", [manifest["stale_reason"] or "marked stale"], None
    if members is None or pages is None or edges is None:
        return "stale", ["no graph"], None
    if manifest["report_schema"] != reports.SCHEMA:
        return "schema_unsupported", ["schema"], None
    bad = reports.stale_reasons(made, members, pages, edges, manifest["report_count"]).limit(50).collect()
    names = sorted({r["reason"] for r in bad})
    return reports.status_of(names), names, None if names else made


def ask(spark: SparkSession, query: str, planner: Planner, index: dict, context: Context | None = None, k: int = 5, base: int = 4096, embed: Callable | None = None, intent: str = "auto",
        mode: str | None = None, hard_max: int | None = None, report_root: str | None = None, members: DataFrame | None = None, snapshot: DataFrame | None = None, local_fallback: bool = False) -> Result:
    """Answer one question.

    A global question is answered by fresh community reports only; without them the result
    says why and what to do, unless ``local_fallback`` lets it be answered like any other,
    with a warning. A question without hits is tried once more by the planner's second plan.
    members, snapshot: (node, community_id) and (page_id, sha256) of the graph as it is.
    """
    about = context or Context()
    plan = planner.plan(query, about)
    plan = plan if intent == "auto" else plan.with_intent(intent)
    result = Result(query, plan)
    if plan.intent == "global":
        status, reasons, made = report_gate(spark, report_root, members, snapshot, index.get("edges"))
        result.status, result.reasons = status, reasons
        if made is not None:
            return _from_reports(spark, result, made, k, base, mode, hard_max)
        result.action = REBUILD
        if not local_fallback:
            return result
        result.fallback, result.warning = True, f"local evidence only: community reports are {status}"
    second = planner.retry(plan, 0, about)
    rows = plan_rows(spark, [plan], embed)
    again = plan_rows(spark, [second], embed) if second else None
    found, items, whole = retrieval.answer(rows, index, k, base, mode, hard_max, again)
    result.items = [json.loads(r["item"]) for r in retrieval.item_json(items, found).orderBy("place").collect()]  # of one question
    result.omitted = [{"page_id": r["page_id"], "reason": r["omitted"]} for r in items.where("omitted is not null").orderBy("place").collect()]
    result.markdown = retrieval.markdown(items, whole, found).first()["markdown"]
    result.budget = whole.first().asDict()
    result.n_graph = sum(1 for i in result.items if i.get("graph_paths"))
    return result


def _from_reports(spark: SparkSession, result: Result, made: DataFrame, k: int, base: int, mode: str | None, hard_max: int | None) -> Result:
    times = 1.0 if mode else MODES[result.plan.context_mode][1]
    planned = int(base * times)
    effective = min(planned, hard_max) if hard_max else planned
    asked = spark.createDataFrame([(0, list(report_terms(result.plan)))], "query_id long, terms array<string>")
    chosen = reports.select(made, asked, k, effective).join(made.select("community_id", "title", "text"), "community_id").orderBy("place").collect()  # k reports
    result.items = [{"page_id": str(r["community_id"]), "title": r["title"], "snippet": r["text"], "tokens": r["token_count"], "method": "global_community_report", "scope": "full_page"} for r in chosen]
    result.budget = {"bundle_mode": "summary", "base_tokens": base, "planned_tokens": planned, "effective_tokens": effective, "token_count": sum(r["token_count"] for r in chosen)}
    result.markdown = "\n\n".join(f"### {r['title']}\n{r['text']}" for r in chosen)
    if len(chosen) < min(k, made.count()):
        result.reasons = ["one or more reports exceeded the budget"]
    return result


def evaluate(spark: SparkSession, gold: DataFrame, planner: Planner, index: dict, base: int = 4096, embed: Callable | None = None, k: int = 10, hard_max: int | None = None) -> tuple[dict[str, float], DataFrame]:
    """(metrics, detail) of labelled questions (query, intent, relevant_pages, required_facts), all in one batch.

    Questions are bounded by what people label; their plans are made on the driver.
    """
    labelled = gold.select("query", "intent", "relevant_pages", "required_facts").collect()
    plans = [planner.plan(r["query"]) for r in labelled]
    found, items, whole = retrieval.answer(plan_rows(spark, plans, embed), index, k, base, None, hard_max)
    names = spark.createDataFrame([(n, r["intent"], p.intent, list(r["relevant_pages"] or ()), list(r["required_facts"] or ())) for n, (r, p) in enumerate(zip(labelled, plans))], "query_id long, intent string, planned_intent string, gold array<string>, facts array<string>")
    hits = metrics.page_hits(found.select("query_id", "page_id", "rank"), names.select("query_id", F.explode("gold").alias("name")))
    per = hits.groupBy("query_id").agg(F.sum((F.col("hit") & (F.col("rank") <= 5)).cast("int")).alias("top5"), F.min(F.when(F.col("hit") & (F.col("rank") <= 10), F.col("rank"))).alias("first"))
    text = retrieval.markdown(items, whole, found).withColumnRenamed("markdown", "context")
    evidence = metrics.evidence_recall(names.select("query_id").join(text, "query_id", "left").fillna("", ["context"]), names.select("query_id", F.explode("facts").alias("fact"))).withColumnRenamed("recall", "evidence_recall")
    bare = items.where("category = 'graph' and omitted is null").join(found.where(F.size("evidence") == 0).select("query_id", "page_id"), ["query_id", "page_id"]).groupBy("query_id").agg(F.count("*").alias("unsupported"))
    detail = names.join(per, "query_id", "left").join(evidence, "query_id", "left").join(whole, "query_id", "left").join(bare, "query_id", "left").fillna(0, ["top5", "unsupported"]).select(
        "query_id", "intent", "planned_intent", F.least(F.lit(1.0), F.col("top5") / F.greatest(F.size("gold"), F.lit(1))).alias("page_recall"), "evidence_recall",
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("first") <= 3, F.lit(False)).alias("hit3"), "base_tokens", "planned_tokens", "effective_tokens", "token_count", "violations", "unsupported",
    )
    sums = detail.agg(F.avg("page_recall").alias("page_recall"), F.avg("evidence_recall").alias("evidence_recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.when(F.col("intent") == "lookup", F.col("hit3").cast("int"))).alias("hit")).first().asDict()
    counters = metrics.bundle_counters(detail).first().asDict()
    return {k_: v for k_, v in (sums | counters).items() if v is not None}, detail


def save_evaluation(spark: SparkSession, folder: str, figures: dict[str, float], detail: DataFrame, schema: int, baseline: bool = False) -> list[str]:
    """Write results and detail; with ``baseline`` they become the baseline, else the reasons to fail against it (none without one)."""
    files.write(spark, f"{folder}/results.json", json.dumps(figures, sort_keys=True))
    detail.write.mode("overwrite").json(f"{folder}/detail")
    where = f"{folder}/baselines.json"
    if baseline:
        files.write(spark, where, json.dumps(figures | {"chunk_schema": schema}, sort_keys=True))
        return []
    if not files.exists(spark, where):
        return []
    base = json.loads(files.read(spark, where))
    return metrics.gate(figures, base, schemas=(schema, base.get("chunk_schema", -1)))

