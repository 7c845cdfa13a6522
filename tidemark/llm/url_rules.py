"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule (a host-and-path rule or a regular expression) names the literal tokens that any URL it fits must hold. The rule
is filed under the one of them that fewest URLs hold. A URL's tokens fetch the candidate rules; only those run their
regular expressions. Rules without a literal token are candidates for every URL.

Host-and-path rules decide first: a rule fits its host and all subdomains when the path starts with the rule's path; the
longest rule wins. Elsewhere pattern rules decide: block if a block pattern and no allow pattern fits, else allow.

Defined results: a null URL or one without "://" has an empty host and path, fits no host rule, and is judged by the
patterns alone (null: as an empty string). Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(r"[a-z0-9]+")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
#: Beyond so many bytes of rules they are applied in shards, each over the URLs once.
MOST_RULE_BYTES = 16_000_000


@dataclass(frozen=True)
class HostRule:
    """rule: host, then the path from its first slash on."""

    verdict: str
    rule: str

    @property
    def regex(self) -> str:
        return r"(?:[^/]*\.)?" + re.escape(self.rule)

    @property
    def tokens(self) -> set[str]:
        """The last token may go on in a URL, unless something ends it in the rule."""
        return {m[0] for m in TOKEN.finditer(self.rule.lower()) if m.end() < len(self.rule)}


@dataclass(frozen=True)
class PatternRule:
    """regex is searched in the lower-cased URL; tokens are whole tokens of every URL it fits."""

    verdict: str
    regex: str
    tokens: frozenset[str] = frozenset()


class RuleIndex:
    def __init__(self, rules: list, frequency: dict[str, int]):
        self.filed: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            kept = (r, re.compile(r.regex, re.DOTALL))
            if tokens := sorted(r.tokens, key=lambda t: (frequency.get(t, 0), t)):
                self.filed[tokens[0]].append(kept)
            else:
                self.always.append(kept)

    def judge(self, url: str | None) -> tuple[str, str, HostRule | None, bool, bool, int]:
        """host, path, the host rule that wins, whether a block and an allow pattern fit, candidates."""
        m = _URL.search(url or "")
        host, path = (m[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), m[2]) if m else ("", "")
        lowered, place = (url or "").lower(), host + path
        found = list(self.always)
        for t in {*TOKEN.findall(lowered), *TOKEN.findall(host + path.lower())}:
            found += self.filed.get(t, ())
        best, blocks, allows = None, False, False
        for r, pattern in found:
            if isinstance(r, HostRule):
                if pattern.match(place) and (best is None or (len(r.rule), r.rule) > (len(best.rule), best.rule)):
                    best = r
            elif pattern.search(lowered):
                blocks, allows = blocks or r.verdict == "block", allows or r.verdict == "allow"
        return host, path, best, blocks, allows, len(found)


def token_frequency(urls: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """How many URLs hold each of the rules' tokens, over all URLs; the answer is as large as the rule set at most.

    The tokens are those of at most MOST_RULE_BYTES of rules, so they are broadcast and a very common token is counted where it lies.
    """
    if not tokens:
        return {}
    held = urls.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(`{url}`), '[a-z0-9]+', 0)"))).alias("t"))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    return {r["t"]: r["n"] for r in held.join(F.broadcast(wanted), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n")).collect()}


def _shards(rules: list) -> list[list]:
    """The rules in parts of at most MOST_RULE_BYTES (one rule at least)."""
    out, size = [[]], 0
    for r in rules:
        n = len(r.regex)
        if out[-1] and size + n > MOST_RULE_BYTES:
            out.append([])
            size = 0
        out[-1].append(r)
        size += n
    return out


def filter_urls(pages: DataFrame, rules: list, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, n_candidates (rules whose regular expressions ran) for every row of pages.

    Each shard of rules is one more narrow pass over the URLs, which carries what the shards before it have found."""
    state = "host string, path string, rule string, rule_verdict string, blocks boolean, allows boolean, n_candidates long"
    kind = pages.schema[key].dataType.simpleString()
    judged = pages.select(F.col(key).alias("_key"), pages[url].cast("string").alias("_url"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in state.split(", ")])
    for shard in _shards(rules):
        judged = _judged(judged, shard, f"_key {kind}, _url string, {state}")
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise("allow"))
    return judged.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "n_candidates")


def _judged(urls: DataFrame, rules: list, schema: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast((rules, token_frequency(urls, set().union(*(r.tokens for r in rules)), "_url")))  # of bounded size
    held: list[RuleIndex] = []

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "_url"):
                if not held:
                    held.append(RuleIndex(*shared.value))
                rows = []
                for u, rule, verdict, blocks, allows, n in zip(*(batch.column(c).to_pylist() for c in ("_url", "rule", "rule_verdict", "blocks", "allows", "n_candidates"))):
                    host, path, best, b, a, more = held[0].judge(u)
                    if best is not None and (rule is None or (len(best.rule), best.rule) > (len(rule), rule)):
                        rule, verdict = best.rule, best.verdict
                    rows.append((host, path, rule, verdict, b or bool(blocks), a or bool(allows), more + (n or 0)))
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=batch.schema.names)

    return urls.mapInArrow(body, schema)
