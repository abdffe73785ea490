"""The whole of it as one object: lint, trace, reports, rules, overrides."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import enrich, grounding, rules, score, stores, trace
from .operators.ruleset import Ruleset, RulesetError, rule_table
from .session import kept


class Engine:
    """Rulesets by name, type overrides and stored reports; the tables are DataFrames that the caller keeps."""

    def __init__(self, spark: SparkSession, rulesets: list[Ruleset] | None = None):
        self.spark = spark
        self._rulesets = {r.id: r for r in rulesets or [Ruleset()]}

    def ruleset(self, name: str = "default") -> Ruleset:
        if name not in self._rulesets:
            raise RulesetError(f"no ruleset {name}")
        return self._rulesets[name]

    def rulesets(self) -> DataFrame:
        return self.spark.createDataFrame([(r.id, r.name, r.version) for r in self._rulesets.values()], "id string, name string, version int")

    def rules(self, name: str = "default") -> DataFrame:
        return rule_table(self.spark, self.ruleset(name))

    def lint(
        self, documents: DataFrame, blocks: DataFrame, links: DataFrame, ruleset: str = "default", overrides: DataFrame | None = None, answers: DataFrame | None = None, now: datetime | None = None,
        model: Callable[[str, str], str] | None = None, gate: DataFrame | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """Findings and scores (uri, scores, truncated, model_status, rejected, calls). Documents are cut at the limit of blocks.

        A model's recorded answers (uri, chunk_index, answer) are tested and added if given; or a ``model`` is asked about
        the documents that no ``gate`` (uri, gate: see stores.model_gate) holds back, whose status is skipped. Without either, rules alone
        judge, which is also the first phase of a report in two."""
        chosen = self.ruleset(ruleset)
        if overrides is not None:
            documents = stores.with_overrides(documents, overrides)
        kept_, led = enrich.truncate(blocks, links)
        found = rules.findings(documents, kept_, led, chosen, now)
        state = None
        if answers is not None:
            tested = grounding.verify(grounding.candidates(answers), documents, kept_, chosen)
            found = found.unionByName(grounding.accepted(tested, chosen))
        elif model is not None:
            held = gate.where("gate is not null").select("uri").distinct() if gate is not None else None
            asked = documents if held is None else documents.join(held, "uri", "left_anti")
            said, state = grounding.analyze(asked, kept_.join(asked.select("uri"), "uri", "left_semi"), model, kept, chosen)
            found = found.unionByName(said)
        scores = score.scores(documents, found, chosen).join(enrich.truncated(blocks), "uri", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        scores = scores.select("*", none("status", "string"), none("rejected", "long"), none("calls", "long")) if state is None else scores.join(state.drop("chunks"), "uri", "left")
        scores = scores.withColumn("model_status", F.coalesce("status", F.lit("skipped"))).drop("status")
        return found, scores.withColumn("rejected", F.coalesce("rejected", F.lit(0))).withColumn("calls", F.coalesce("calls", F.lit(0)))

    def trace(self, documents: DataFrame, blocks: DataFrame, links: DataFrame, model: Callable[[str, str], str] | None = None, limit: int = fixed.MAX_PAIRS) -> tuple[DataFrame, DataFrame]:
        """Findings across all documents, and a summary of one row.

        With a ``model`` the pairs of documents that share most identifiers are compared by it; pairs_considered and
        pairs_analyzed say how many there are and how many were."""
        m = kept(trace.mentions(documents, blocks), "mentions")
        found = trace.trace_findings(documents, m, links)
        if model is None:
            return found, trace.summary(documents, m, found)
        pairs = kept(trace.top_pairs(m, limit), "pairs")
        snippets = trace.pair_snippets(m, pairs)
        answers = kept(grounding.ask(grounding.pair_prompts(pairs, snippets, documents), model), "pair-answers")
        titles = documents.select("uri", "title").distinct()
        side = lambda s: titles.select(F.col("uri").alias(f"u_{s}"), F.col("title").alias(f"t_{s}"))
        said = grounding.contradictions(answers.where("ok"), snippets, pairs)
        said = said.join(side("a"), F.get("documents", F.lit(0)) == F.col("u_a")).join(side("b"), F.get("documents", F.lit(1)) == F.col("u_b"))
        found = found.unionByName(said.withColumn("titles", F.array("t_a", "t_b")).select(*found.columns))
        counts = trace.pairs_considered(m).crossJoin(answers.agg(F.count(F.when(F.col("ok"), 1)).alias("pairs_analyzed")))  # one row each
        return found, trace.summary(documents, m, found).crossJoin(counts.withColumnRenamed("considered", "pairs_considered"))  # one row each

    def reports(self, stored: DataFrame, uri: str, limit: int = 20) -> DataFrame:
        return stores.newest_reports(stored, uri, limit)

    def new_reports(self, documents: DataFrame, blocks: DataFrame, links: DataFrame, stored: DataFrame, prompt: str, ruleset: str = "default", now: datetime | None = None) -> DataFrame:
        """Reports (keys, uri, scores, findings) of the documents that have none stored under their content's hash."""
        chosen = self.ruleset(ruleset)
        hashes = enrich.document_hash(documents, blocks, links)
        todo = stores.not_cached(hashes, stored, chosen.id, chosen.version, prompt)
        keep = lambda df: df.join(todo.select("uri"), "uri", "left_semi")
        found, scores = self.lint(keep(documents), keep(blocks), keep(links), ruleset, now=now)
        listed = found.groupBy("uri").agg(F.collect_list(F.struct("id", "rule_id", "severity", "block_id", "evidence")).alias("findings"))
        return scores.join(todo, "uri").join(listed, "uri", "left").withColumn("ruleset_id", F.lit(chosen.id)).withColumn("ruleset_version", F.lit(chosen.version)).withColumn("prompt_version", F.lit(prompt))
