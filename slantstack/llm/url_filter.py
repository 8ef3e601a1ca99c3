"""URL filters: hosts are cut into words by unigram Viterbi, and multinomial naive Bayes scores host and path tokens.

Unigrams: words of all pages' visible text and of their urls, counted over the whole table; the ``LEXICON`` most frequent
are broadcast. A name is cut where the product of its words' frequencies is largest; unknown words cost more the longer they are.

Naive Bayes learns from the domain rules' verdicts: every page that a rule decides is an example of the rule's action, by
the tokens of what the rule doesn't name (the host before the rule's domain, the path behind the rule's). So a label is no
function of the tokens scored. Tokens of all examples are counted by label; the ``TOKENS`` most frequent are broadcast. A page that no
rule decides is blocked if its posterior is above 0.5.

Domain rules (host, path prefix) come first: a rule fits its host and subdomains where the path starts with the rule's,
and the longest fitting one decides.

Bounds: lexicon and tokens of 50,000 and 100,000 rows at most are held by driver and workers. Hosts longer than ``WHOLE``
characters a label are cut in pieces of that length first.

Defined results. Null url or none with "://": empty host and path, no rule; the method's verdict is then the prior's.
Null page ids and repeated rows: a result each. No page that a rule decides: everything else is allowed. Empty table: empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, frequent, small_batches

LEXICON, TOKENS, LONGEST, WHOLE = 50_000, 100_000, 24, 4096
_SPLIT = re.compile(r"[^0-9a-z\x80-\U0010ffff]+")
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    """host and path columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_AZ)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules: list[tuple[str, str, str]]):
    """The longest fitting rule (as host/path) and its action; rules: action, host, path. Ties go to the first."""
    which = action = F.lit(None).cast("string")
    for act, host, path, fits in _fitting(rules):
        which, action = F.when(fits, host + path).otherwise(which), F.when(fits, act).otherwise(action)
    return which, action


def _fitting(rules: list[tuple[str, str, str]]):
    for act, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        yield act, host, path, ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def rest_columns(rules: list[tuple[str, str, str]]):
    """What the rule that decides doesn't name: the host before its domain and the path behind its path."""
    rest_host, rest_path = F.col("host"), F.col("path")
    for _, host, path, fits in _fitting(rules):
        rest_host = F.when(fits, F.substring(F.col("host"), F.lit(1), F.length("host") - len(host))).otherwise(rest_host)
        rest_path = F.when(fits, F.substring(F.col("path"), F.lit(len(path) + 1), F.length("path"))).otherwise(rest_path)
    return rest_host, rest_path


class Cutter:
    """Names to words."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values())
        self.logs = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = -math.log(total)
        self.cut = lru_cache(100_000)(self._cut)

    def _cut(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            options = [(best[i] + self.logs.get(name[i:j], self.unknown - 2.3 * (j - i)), i) for i in range(max(0, j - LONGEST), j)]
            b, i = max(options)
            best.append(b)
            back.append(i)
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return tuple(reversed(out))

    def host(self, host: str) -> list[str]:
        """Words of all labels but www; numbers and blanks cut as they stand."""
        labels = [label[i : i + WHOLE] for label in _SPLIT.split(host) if label != "www" for i in range(0, len(label), WHOLE)]
        return [w for label in labels for w in self.cut(label)]


def features(cutter: Cutter, host: str, path: str) -> tuple[list[str], list[str]]:
    words = cutter.host(host)
    return words, [f"h:{w}" for w in words] + [f"p:{w}" for w in _SPLIT.split(path.translate(str.maketrans(*_AZ))) if w]


def lexicon(pages: DataFrame, url_col: str, html_col: str | None) -> dict[str, int]:
    texts = [F.translate(F.col(url_col), *_AZ)]
    if html_col:
        texts.append(F.translate(F.regexp_replace(F.col(html_col), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "), *_AZ))
    words = pages.select(F.explode(F.split(F.concat_ws(" ", *texts), r"[^a-z\x80-\x{10ffff}]+")).alias("w")).where(F.length("w").between(1, LONGEST))
    counted = durable(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    counts = {r["w"]: r["n"] for r in frequent(counted, LEXICON, "w").collect()}
    discard(counted)
    return counts


def _labeller(shared):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        for b in batches:
            found = [features(cutter, h, p) for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([t for _, t in found], pa.list_(pa.string()))], names=["bad", "tokens"])

    return label


def train(pages: DataFrame, rules: list[tuple[str, str, str]], *, url_col: str = "url", html_col: str | None = "html") -> tuple[dict, list[int], dict]:
    """Lexicon, examples by label (allow, block) and {token: counts by label}."""
    sc = pages.sparkSession.sparkContext
    counts = lexicon(pages, url_col, html_col)
    host, path = parts(F.col(url_col))
    (_, action), (rest_host, rest_path) = rule_columns(rules), rest_columns(rules)
    examples = pages.select(host.alias("host"), path.alias("path")).select(rest_host.alias("h"), rest_path.alias("p"), (action == "block").alias("bad")).where("bad is not null")
    labelled = examples.mapInArrow(_labeller(sc.broadcast(counts)), "bad boolean, tokens array<string>")
    token = F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token")  # "" counts the pages
    by = labelled.select("bad", token).groupBy("token").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    counted = durable(by.withColumn("n", F.col("good") + F.col("bad")), "tokens")
    table = {r["token"]: (r["good"], r["bad"]) for r in frequent(counted, TOKENS, "token").collect()}
    discard(counted)
    return counts, list(table.pop("", (0, 0))), table


def _judge(shared):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pages, table = shared.value
        cutter, sums = Cutter(counts), [sum(c[k] for c in table.values()) + len(table) + 1 for k in (0, 1)]
        prior = math.log((pages[1] + 1) / (pages[0] + 1))
        ratio = {t: math.log((c[1] + 1) / sums[1]) - math.log((c[0] + 1) / sums[0]) for t, c in table.items()}
        for b in batches:
            words, p = [], []
            for h, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w, tokens = features(cutter, h, path)
                z = prior + sum(ratio.get(t, 0.0) for t in tokens)
                words.append(w)
                p.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(words, pa.list_(pa.string())), pa.array(p)], names=[*b.schema.names, "words", "p_block"])

    return judge


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, words (of the host) and p_block of every row."""
    small_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(train(pages, rules, url_col=url_col, html_col=html_col))
    host, path = parts(F.col(url_col))
    rule, action = rule_columns(rules)
    read = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    out = read.mapInArrow(_judge(model), f"page_id {read.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, action string, words array<string>, p_block double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "words", "p_block")
