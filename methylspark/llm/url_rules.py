"""URL filter by pattern rules that are indexed by their rarest literal token.

A rule has a glob for the host, which also fits all subdomains, and one for the start of the path.
``*`` stands for any characters, ``^`` for a place that does not lie inside a token, and ``|`` at the
end of a path for the path's end. A token is a run of ASCII letters and digits, compared in lower case.
Tokens of a rule that must be whole tokens of every URL it fits are its literal tokens; it is filed
under the one that the fewest URLs hold (ties: the longer, then the smaller one). The tokens of a URL
fetch the rules filed under them, and only those run their regular expressions. A rule without a
literal token is a candidate of every URL. Of the rules that fit, the highest tier wins, then the
longest text, then ``block``, then the smaller text; a URL without a rule is allowed.

The index travels to the tasks while it has at most :data:`LOCAL_RULES` rules, so URLs are not
shuffled. Beyond, tokens of distinct hosts and paths are joined with it; tokens that many URLs hold
are dealt over salts, as are URLs that occur often. Both ways give the same rows.

A URL that is null or has no ``://`` has an empty host and path, as have those where nothing follows;
such rows stay and are allowed unless a rule without tokens fits. Repeated rows are judged alike, an
empty table gives an empty result, and columns other than the carried ones and ``url`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methylspark.llm.tables import Written, maybe_small


class Rule(NamedTuple):
    action: str
    host: str
    path: str = ""
    tier: int = 0

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules for sites and languages.
SITES = [Rule("allow", "org", "/", 1), Rule("block", "example.org", "/es/", 1),
         Rule("block", "example.org", "/en/1", 1), Rule("allow", "com", "/fr/", 1),
         Rule("block", "com", "/de/", 1)]

#: Words of hosts whose pages are no use as text.
HOST_WORDS = ("ads adserver adult bet bets betting casino doubleclick escort malware phishing pills "
              "poker porn sex slots spam track tracker viagra warez xxx").split()

#: Rules for kinds of hosts and for paths that hold no text.
KINDS = [Rule("block", f"*^{word}^*") for word in HOST_WORDS] + [
    Rule("block", "*", path) for path in ("/*.exe|", "/*.zip|", "/*.iso|", "/cgi-bin/", "/wp-login.php",
                                          "/wp-admin/")]

RULES = SITES + KINDS

#: Rules that are sent to every task: some 20 MB. Beyond, they are joined.
LOCAL_RULES = 100_000
#: URLs that one task gets for one token, or for one host and path, in a join.
HOT = 1_000_000

TOKEN = re.compile("[0-9a-z]+")
_END = r"(?![\s\S])"
_EDGE = "(?:(?<![0-9A-Za-z])|(?![0-9A-Za-z]))"

RULE_TABLE = ("rule INT, action STRING, host_glob STRING, path_glob STRING, tier INT, "
              "host_regex STRING, path_regex STRING, literals ARRAY<STRING>")


def _glob(text: str) -> str:
    return "".join({"*": r"[\s\S]*", "^": _EDGE}.get(c) or re.sub(r"([^0-9A-Za-z])", r"\\\1", c)
                   for c in text)


def regexes(rule: Rule) -> tuple[str, str]:
    """Expressions for host and path, to be matched from their starts."""
    ends = rule.path.endswith("|")
    return (rf"^(?:[\s\S]*\.)?{_glob(rule.host)}{_END}",
            "^" + _glob(rule.path[:-1] if ends else rule.path) + (_END if ends else ""))


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that every URL of the rule holds as whole tokens."""
    found = []
    for glob, open_end in ((rule.host, False), (rule.path, True)):
        glob = glob.lower()
        for m in TOKEN.finditer(glob):
            before, after = glob[:m.start()][-1:], glob[m.end():][:1]
            if before != "*" and after != "*" and (after or not open_end):
                found.append(m[0])
    return sorted(set(found))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows. Lists too long for a driver are made as such a table in the first place."""
    return spark.createDataFrame(
        [(k, r.action, r.host, r.path, r.tier, *regexes(r), literal_tokens(r))
         for k, r in enumerate(rules)], RULE_TABLE)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    def part(k: int) -> Column:
        return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit(""))

    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def _tokens(host: Column, path: Column) -> Column:
    """Different tokens of a URL, and the empty one, under which rules without a token are filed."""
    lowered = F.translate(F.concat(host, F.lit(" "), path),
                          "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_append(F.regexp_extract_all(
        lowered, F.lit("([0-9a-z]+)")), F.lit("")))


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with ``token``, the rarest of their literal tokens in ``urls(host, path)``, and
    ``n_urls``, how many of the URLs hold it. One pass over the URLs, counted before the shuffle."""
    filed = rules.withColumn("token", F.explode(F.array_append("literals", F.lit(""))))
    wanted = Written(rules.sparkSession)(filed.select("token").distinct())
    counts = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(
        maybe_small(wanted), "token", "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("n_urls"))
    # the empty token is taken where there is no other
    rarest = filed.join(counts, "token", "left").fillna(0, ["n_urls"]).groupBy("rule").agg(
        F.min(F.struct(F.expr("token = ''").alias("empty"), "n_urls",
                       (-F.length("token")).alias("length"), "token")).alias("r"))
    return rules.join(rarest, "rule").select(
        rules["*"], F.col("r.token").alias("token"), F.col("r.n_urls").alias("n_urls"))


def _judge_locally(urls: DataFrame, rows: list, carry: Sequence[str]) -> DataFrame:
    """Every task holds the whole index."""
    by_token: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (-r.tier, -len(r.pattern), r.action != "block", r.pattern,
                                         r.rule)):
        by_token.setdefault(r.token, []).append((
            (-r.tier, -len(r.pattern), r.action != "block", r.pattern, r.rule), r.host_regex,
            r.path_regex, r.action))
    shared = urls.sparkSession.sparkContext.broadcast(by_token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = {token: [(rank, re.compile(host), re.compile(path), action)
                         for rank, host, path, action in entries]
                 for token, entries in shared.value.items()}

        def winner(host: str, path: str) -> dict | None:
            best = None
            tokens = set(TOKEN.findall(f"{host} {path.translate(_LOWER)}"))
            for token in (tokens & filed.keys()) | {""}:
                for entry in filed.get(token, ()):  # the best first
                    if best and best[0] < entry[0]:
                        break
                    if entry[1].match(host) and entry[2].match(path):
                        best = entry
                        break
            return best and {"rule": best[0][4], "tier": -best[0][0], "pattern": best[0][3],
                             "action": best[3]}

        for batch in batches:
            won = list(map(winner, batch.column("host").to_pylist(),
                           batch.column("path").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(won, _WON)],
                                             [*batch.schema.names, "won"])

    given = urls.select(*carry, "host", "path")
    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField(
        "won", T.StructType.fromDDL("rule INT, tier INT, pattern STRING, action STRING"))]))


_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
_WON = pa.struct([("rule", pa.int32()), ("tier", pa.int32()), ("pattern", pa.string()),
                  ("action", pa.string())])


def _judge_by_join(urls: DataFrame, filed: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Candidates by an equi-join of tokens, with hot tokens and hot URLs dealt over salts."""
    keep = Written(urls.sparkSession)
    filed = keep(filed)
    places = keep(urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_rows")))

    def shares(n: str) -> Column:
        return (F.floor(F.col(n) / HOT) + 1).cast("int")

    hot = filed.filter(F.col("n_urls") >= HOT).select(
        "token", shares("n_urls").alias("salts")).distinct()
    of_urls = places.withColumn("token", F.explode(_tokens(F.col("host"), F.col("path")))).join(
        F.broadcast(hot), "token", "left").withColumn("salt", F.pmod(
            F.xxhash64("host", "path"), F.coalesce("salts", F.lit(1))).cast("int"))
    of_rules = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), shares("n_urls") - 1)))
    won = of_urls.join(of_rules, ["token", "salt"]).filter(
        F.rlike("host", F.col("host_regex")) & F.rlike("path", F.col("path_regex"))).groupBy(
        "host", "path").agg(F.min(F.struct(
            (-F.col("tier")).alias("t"), (-F.length("pattern")).alias("l"),
            (F.col("action") != "block").alias("a"), "pattern", "rule", "tier",
            "action")).alias("w"))
    judged = places.join(won, ["host", "path"]).select(
        "host", "path", F.struct("w.rule", "w.tier", "w.pattern", "w.action").alias("won"),
        F.explode(F.sequence(F.lit(0), shares("n_rows") - 1)).alias("salt"))
    often = keep(places.filter(F.col("n_rows") >= HOT).select(
        "host", "path", shares("n_rows").alias("salts")))
    given = urls.select(*carry, "host", "path").join(
        F.broadcast(often), ["host", "path"], "left").withColumn(
        "salt", F.floor(F.rand(7) * F.coalesce("salts", F.lit(1))).cast("int"))
    return given.join(judged, ["host", "path", "salt"], "left").select(
        *carry, "host", "path", "won")


def judge(pages: DataFrame, rules: DataFrame, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """``carry``, ``host``, ``path``, ``won`` (``rule``, ``tier``, ``pattern``, ``action`` of the
    winning rule, null where none fits) and ``verdict`` of every row of ``pages``."""
    host, path = parts(F.col("url").cast("string"))
    carry = list(carry)
    urls = pages.select(*carry, host.alias("host"), path.alias("path"))
    rules = Written(pages.sparkSession)(rules.withColumn(
        "pattern", F.concat("host_glob", "path_glob")))
    filed = index(rules, urls)
    judged = (_judge_locally(urls, filed.collect(), carry) if rules.count() <= LOCAL_RULES
              else _judge_by_join(urls, filed, carry))
    return judged.withColumn("verdict", F.coalesce("won.action", F.lit("allow")))
