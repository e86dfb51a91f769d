"""The review as a whole: bounded loops over tables, each turn asking a model only about what is still open.

Contracts go through the steps together, but each by its own state: law is looked up again for candidates without a
verdict, the judge is asked again about contracts it gave no answer for, contracts whose facts were unclear go back to
clause review once, and those in whose risks arbitration finds a material conflict go back to the judge once. What a
step has made is written before the next one reads it, so that no answer is asked for twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import elements, prompts, review, signals
from ..operators.segment import Asker
from ..scratch import written

KEY = "contract_id"
PAIR = ["contract_id", "candidate_id"]
COUNTERS = ("legal_retries", "judge_retries", "evidence_rounds", "arbitration_rounds")


@dataclass
class Limits:
    legal_retries: int = 1
    judge_retries: int = 1
    evidence_rounds: int = 1
    arbitration_rounds: int = 1


@dataclass
class Review:
    risks: DataFrame
    queue: DataFrame
    overall: DataFrame
    counters: dict[str, int]  # the greatest of any contract
    loops: DataFrame  # contract_id and the counters
    understanding: DataFrame
    conflicts: DataFrame
    merged: DataFrame  # candidates
    elements: DataFrame

    def report(self) -> DataFrame:
        counts = self.merged.groupBy(KEY).agg(F.count("*").alias("merged_candidates"))
        return review.report_json(self.risks, self.queue, self.overall, self.loops, self.conflicts, counts)


def _instead(old: DataFrame | None, new: DataFrame, who: DataFrame) -> DataFrame:
    """old's rows of other contracts, and new, which has those of `who`."""
    return written(new if old is None else old.join(who, KEY, "left_anti").unionByName(new))


def _counted(loops: DataFrame, name: str, who: DataFrame, reset: bool = False) -> DataFrame:
    marked = loops.join(who.select(KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left")
    value = F.lit(0) if reset else F.col(name) + 1
    return written(marked.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name))).drop("_hit"))


def _below(loops: DataFrame, name: str, limit: int, who: DataFrame) -> DataFrame:
    return who.select(KEY).distinct().join(loops.filter(F.col(name) < limit).select(KEY), KEY, "left_semi")


def run_review(tree: DataFrame, ask: Asker, search, limits: Limits | None = None) -> Review:
    """Understanding, elements, candidates, law, judgement, arbitration and fusion for all contracts of a clause tree.

    ask: a model, by schema name and requests (contract_id, batch, prompt), to contract_id, batch, response; null where it
    failed. search: (contract_id, candidate_id, text) to the articles found (contract_id, candidate_id, article_uid,
    law_name, article_no, source_url). Every failure costs its own step of its own contract: without a judge all
    candidates stay for review, without arbitration there are no conflicts.
    """
    limits = limits or Limits()
    only = lambda frame, who: frame.join(who, KEY, "left_semi")
    asked = lambda schema, requests: written(ask(schema, requests).select(KEY, "batch", "response"))
    everyone = written(tree.select(KEY).distinct())
    loops = everyone.select(KEY, *[F.lit(0).alias(c) for c in COUNTERS])
    understanding = written(review.understood(asked("contract_understanding", prompts.understanding(tree)), tree))
    merged_elements, _ = elements.with_model(tree, asked("contract_element_extraction", prompts.extraction(tree)))
    held = written(merged_elements)
    said = written(signals.signals(tree, held))
    cross = written(review.cross_candidates(asked("cross_clause_conflict_review", prompts.cross_review(tree)), tree))
    notes = tree.sparkSession.createDataFrame([], f"{KEY} {dict(tree.dtypes)[KEY]}, notes array<string>")

    merged = applied = parsed = conflicts = None
    to_review, to_judge = everyone, None
    while True:
        if to_review is not None:
            part = only(tree, to_review)
            clause = review.clause_candidates(asked("clause_risk_review", prompts.clause_review(part)), part)
            offset = clause.groupBy(KEY).agg(F.max("seq").alias("_n"))
            after = only(cross, to_review).join(offset, KEY, "left").withColumn("seq", F.col("seq") + F.coalesce("_n", F.lit(0))).drop("_n")
            fresh = written(review.merge_candidates(clause.unionByName(after)))
            merged = _instead(merged, fresh, to_review)
            loops = _counted(loops, "legal_retries", to_review, reset=True)
            now, loops = _law(fresh, part, asked, search, limits, loops)
            applied = _instead(applied, now, to_review)
            to_judge = to_review if to_judge is None else written(to_judge.unionByName(to_review).distinct())

        candidates = only(merged, to_judge)
        unheard, heard = written(candidates.select(KEY).distinct()), None
        while not unheard.isEmpty():
            requests = prompts.judge(only(candidates, unheard), applied, understanding, notes)
            answers = asked("final_adjudication", requests).join(unheard, KEY, "left_semi")
            good = written(answers.select(KEY, F.from_json("response", review.DECISIONS).alias("r")).filter("r.verdicts is not null"))
            heard = good if heard is None else heard.unionByName(good)
            failed = written(unheard.join(good.select(KEY), KEY, "left_anti"))
            loops = _counted(loops, "judge_retries", failed)
            unheard = written(_below(loops, "judge_retries", limits.judge_retries + 1, failed))
        if heard is not None:
            parsed = _instead(parsed, heard, to_judge)
        done = parsed.select(KEY).distinct() if parsed is not None else everyone.limit(0)
        decisions = parsed.select(KEY, F.explode("r.verdicts").alias("v")).select(KEY, "v.*") if parsed is not None else None
        judged = review.fallback(merged.join(done, KEY, "left_anti"))
        if decisions is not None:
            judged = review.adjudicate(only(merged, done), decisions, applied).unionByName(judged)
        judged = written(judged)

        unclear = review.feedback(only(only(merged, to_judge), done), applied).select(KEY).distinct()
        again = written(_below(loops, "evidence_rounds", limits.evidence_rounds, unclear))
        loops = _counted(loops, "evidence_rounds", again)
        rest = written(to_judge.join(again, KEY, "left_anti"))
        risks = only(judged, rest)
        found, material = review.arbitrated(asked("cross_module_arbitration", prompts.arbitration(risks, said, notes)), risks)
        conflicts = _instead(conflicts, found, rest)
        rerun = written(_below(loops, "arbitration_rounds", limits.arbitration_rounds, material.filter("material")))
        loops = _counted(loops, "arbitration_rounds", rerun)
        objections = only(conflicts, rerun).groupBy(KEY).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat_ws("；", "description", "resolution").alias("t")))), lambda x: x["t"]), 1, 5).alias("notes"))
        notes = _instead(notes, objections, rerun)
        to_review = None if again.isEmpty() else again
        to_judge = None if rerun.isEmpty() else rerun
        if to_review is None and to_judge is None:
            break

    final = written(review.fuse(judged, said))
    answers = parsed if parsed is not None else tree.sparkSession.createDataFrame([], f"{KEY} {dict(tree.dtypes)[KEY]}, r {review.DECISIONS}")
    overall = review.overall(tree, merged, answers.select(KEY, "r.overall_assessment", "r.overall_score"), True)
    counters = loops.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in COUNTERS]).first().asDict()
    return Review(final, review.review_queue(final, said), overall, counters, loops, understanding, conflicts, merged, held)


def _law(candidates: DataFrame, tree: DataFrame, asked, search, limits: Limits, loops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, loops): a verdict for each candidate, asked for again with a wider search while any lacks one."""
    open_ones, applied = candidates, None
    for turn in range(limits.legal_retries + 1):
        pool = written(search(review.law_queries(open_ones, tree, retry=turn > 0)))
        answers = asked("legal_application_verdict", prompts.law(open_ones, pool))
        items = answers.select(KEY, F.explode(F.from_json("response", review.VERDICTS)["verdicts"]).alias("v")).select(KEY, "v.*").filter(F.col("assessment").isin(*P.ASSESSMENTS))
        verdicts = items.groupBy(*PAIR).agg(F.max_by(F.struct("assessment", "severity", "reason", "article_uid", "quote"), F.lit(1)).alias("v")).select(*PAIR, "v.*")
        now = written(review.applications(open_ones, verdicts, pool.drop("candidate_id")))
        applied = now if applied is None else written(review.upsert(applied, now, PAIR))
        lacking = review.unresolved(applied).select(*PAIR)
        open_ones = candidates.join(lacking, PAIR, "left_semi")
        if turn == limits.legal_retries or open_ones.isEmpty():
            break
        loops = _counted(loops, "legal_retries", open_ones)
    return applied, loops
