"""What the samples of a document disagree about, and whether an audit's findings stay clear of it.

Alignments of pairs of samples are a table of their own (narrow rows: document, two slots, two claim numbers), made by one small matching per pair
of samples, many pairs to an Arrow batch. Scores, the medoid and the dispute are joins and aggregates of it: a medoid claim is in dispute where the table lacks its row for some sibling.

claims: doc_id, slot, claim (its place in the sample), start, end, owner (null: nobody's). A claim without a proper span aligns with nothing but counts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import written
from .agreement import aligned

#: Outcomes of an audit that was completed, and the finding codes that are a failed gate's own dimension.
AUDITED = ("no_findings", "findings")
WARNING = "warning"
GATE_CODES = {"negation": ["polarity_subject"], "numeric_conflict": ["numeric_scope_unit"]}

_ALIGNED = "slot_a int, slot_b int, claim_a int, claim_b int"
PAIRS_AT_ONCE = 1_000


def sample_pairs(claims: DataFrame, medoids: DataFrame | None = None) -> DataFrame:
    """doc_id, slot_a, slot_b: every two samples of a document (a before b), or the medoid (doc_id, medoid_slot) with each of its siblings."""
    slots = claims.select("doc_id", "slot").distinct()
    b = slots.withColumnRenamed("slot", "slot_b")
    if medoids is None:
        return slots.withColumnRenamed("slot", "slot_a").join(b, "doc_id").where("slot_a < slot_b")
    return medoids.select("doc_id", F.col("medoid_slot").alias("slot_a")).join(b, "doc_id").where("slot_a <> slot_b")


def alignments(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, slot_a, slot_b, claim_a, claim_b: one-to-one, best overlap first, ties to the earlier claim of a, then of b."""
    spans = claims.where("start < end").groupBy("doc_id", "slot").agg(F.array_sort(F.collect_list(F.struct("claim", "start", "end"))).alias("spans"))
    sides = pairs.join(spans.select("doc_id", F.col("slot").alias("slot_a"), F.col("spans").alias("a")), ["doc_id", "slot_a"]).join(spans.select("doc_id", F.col("slot").alias("slot_b"), F.col("spans").alias("b")), ["doc_id", "slot_b"])
    lists = [F.col(side)[part].alias(f"{side}_{part}") for side in "ab" for part in ("claim", "start", "end")]
    return sides.select("doc_id", "slot_a", "slot_b", *lists).mapInArrow(_matched, f"doc_id {claims.schema['doc_id'].dataType.simpleString()}, {_ALIGNED}")


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of alignments() from rows of two samples, each as lists of claims, starts and ends; a batch holds many pairs of samples."""
    for whole in batches:
        for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
            batch = whole.slice(at, PAIRS_AT_ONCE)
            rows, left, right = [], [], []
            for k, (x, xs, xe, y, ys, ye) in enumerate(zip(*(c.to_pylist() for c in batch.columns[3:]))):
                found = aligned(list(zip(xs, xe)), list(zip(ys, ye)))
                rows += [k] * len(found)
                left += [x[i] for i, _ in found]
                right += [y[j] for _, j in found]
            keys = batch.select(["doc_id", "slot_a", "slot_b"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["doc_id", "slot_a", "slot_b", "claim_a", "claim_b"])


def medoids(claims: DataFrame, pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """doc_id, medoid_slot, mean_f1 (against the others): the sample that agrees best, ties to the smaller slot; a sole sample is its own medoid at 1.0.

    pairs and matched are those of every two samples."""
    n = claims.groupBy("doc_id", "slot").agg(F.count("*").alias("n"))
    hits = matched.groupBy("doc_id", "slot_a", "slot_b").agg(F.count("*").alias("hits"))
    sized = pairs.join(n.select("doc_id", F.col("slot").alias("slot_a"), F.col("n").alias("n_a")), ["doc_id", "slot_a"]).join(n.select("doc_id", F.col("slot").alias("slot_b"), F.col("n").alias("n_b")), ["doc_id", "slot_b"])
    scored = sized.join(hits, ["doc_id", "slot_a", "slot_b"], "left").withColumn("f1", 2.0 * F.coalesce("hits", F.lit(0)) / (F.col("n_a") + F.col("n_b")))
    both = scored.select("doc_id", F.explode(F.array("slot_a", "slot_b")).alias("slot"), "f1")
    means = n.join(both.groupBy("doc_id", "slot").agg(F.avg("f1").alias("f1")), ["doc_id", "slot"], "left").withColumn("f1", F.coalesce("f1", F.lit(1.0)))
    best = F.max_by(F.struct("slot", "f1"), F.struct("f1", -F.col("slot"))).alias("m")
    return means.groupBy("doc_id").agg(best).select("doc_id", F.col("m.slot").alias("medoid_slot"), F.col("m.f1").alias("mean_f1"))


def dispute_set(claims: DataFrame, cited: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dispute of every document with a medoid (chosen: doc_id, medoid_slot): its ids, and whether it can be scoped.

    ids: doc_id, kind (statement, block), id. Statements own medoid claims that some sibling lacks. Blocks are cited (doc_id, slot, block_id) by a sibling
    and by no statement of the medoid. scope: doc_id, scoped, one row per document; false where a claim in dispute has no owner. A sibling is a sample with
    claims or citations, so one that cites and claims nothing still disputes all of the medoid's claims."""
    every = claims.select("doc_id", "slot").unionByName(cited.select("doc_id", "slot"))
    pairs = sample_pairs(every, chosen)
    of_medoid = claims.select("doc_id", F.col("slot").alias("slot_a"), F.col("claim").alias("claim_a"), "owner")
    found = alignments(claims, pairs).select("doc_id", "slot_a", "slot_b", "claim_a")
    missed = pairs.join(of_medoid, ["doc_id", "slot_a"]).join(found, ["doc_id", "slot_a", "slot_b", "claim_a"], "left_anti").select("doc_id", "owner").distinct()
    missed = written(missed, "dispute-missed")
    own = chosen.select("doc_id", F.col("medoid_slot").alias("slot")).join(cited, ["doc_id", "slot"]).select("doc_id", "block_id")
    others = cited.join(chosen.select("doc_id", "medoid_slot"), "doc_id").where("slot <> medoid_slot").select("doc_id", "block_id").distinct()
    blocks = others.join(own, ["doc_id", "block_id"], "left_anti")
    ids = missed.where("owner is not null").select("doc_id", F.lit("statement").alias("kind"), F.col("owner").alias("id")).unionByName(blocks.select("doc_id", F.lit("block").alias("kind"), F.col("block_id").alias("id")))
    unowned = missed.where("owner is null").select("doc_id", F.lit(False).alias("_scoped"))
    return ids, chosen.select("doc_id").join(unowned, "doc_id", "left").select("doc_id", F.coalesce("_scoped", F.lit(True)).alias("scoped"))


def _code_named(code: Column, gates: Column, gate_codes: dict[str, list[str]]) -> Column:
    """Whether the code belongs to one of the failed gates."""
    hits = [F.array_contains(gates, gate) & code.isin(*own) for gate, own in gate_codes.items()]
    return functools.reduce(lambda x, y: x | y, [F.coalesce(h, F.lit(False)) for h in hits], F.lit(False))


def audit_scoping(audits: DataFrame, items: DataFrame, ids: DataFrame, scope: DataFrame, gate_codes: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, clean, off_dispute for every audit.

    audits: doc_id, semantics, completeness, blocking, failed_gates. items: doc_id, item (findings and questions: question boolean), severity, code,
    targets, block_id. clean: both parts found nothing and nothing blocks. off_dispute: both parts were completed, all that blocks is in sight (findings
    that are no warnings and questions add up to blocking), and none of it touches the dispute: by a failed gate's code (findings only), by an id in dispute,
    by naming nothing, or because the dispute has no scope. Null counts as not known: such a document is neither."""
    gated = items.withColumn("question", F.coalesce("question", F.lit(False))).where(F.col("question") | ~F.coalesce(F.col("severity") == WARNING, F.lit(False)))
    gated = gated.join(audits.select("doc_id", "failed_gates"), "doc_id").join(scope, "doc_id", "left")
    named = F.array_distinct(F.array_compact(F.concat(F.coalesce("targets", F.array().cast("array<string>")), F.array("block_id"))))
    flat = gated.select("doc_id", "item", named.alias("named"), (~F.coalesce("scoped", F.lit(False)) | (F.size(named) == 0) | (~F.col("question") & _code_named(F.col("code"), F.col("failed_gates"), GATE_CODES if gate_codes is None else gate_codes))).alias("at_once"))
    met = flat.select("doc_id", F.explode("named").alias("id")).distinct().join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi").select("doc_id").distinct()
    seen = flat.groupBy("doc_id").agg(F.count("*").alias("_seen"), F.bool_or("at_once").alias("_at_once"))
    judged = audits.join(seen, "doc_id", "left").join(met.withColumn("_met", F.lit(True)), "doc_id", "left").join(scope.select("doc_id", F.lit(True).alias("_disputed")), "doc_id", "left")
    done = F.col("semantics").isin(*AUDITED) & F.col("completeness").isin(*AUDITED)
    clear = done & F.coalesce("_disputed", F.lit(False)) & (F.col("blocking") == F.coalesce("_seen", F.lit(0))) & ~F.coalesce("_at_once", F.lit(False)) & ~F.coalesce("_met", F.lit(False))
    clean = (F.col("semantics") == AUDITED[0]) & (F.col("completeness") == AUDITED[0]) & (F.col("blocking") == 0)
    return judged.select("doc_id", F.coalesce(clean, F.lit(False)).alias("clean"), F.coalesce(clear, F.lit(False)).alias("off_dispute"))
