"""Secret scanning over an incremental blob ledger.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds, for each blob, the rule
versions it was scanned with; a run fetches one text per blob and applies only the rules the ledger lacks.
Findings belong to a blob and a rule version, and those of the current versions are joined back to all paths (rows)
that hold the blob. DataFrame functions only.

Positions are code points, the end exclusive. ``regexp_extract_all`` gives a rule's leftmost non-overlapping
matches and ``split`` the text between them; their running lengths are the positions.

Defined cases: a null text is the empty text; very long texts are scanned whole; spans of several rules with one
start keep the order of the rules; repeated rows and copies share one blob and each get its
findings; a null path is kept as a row with a null path; an empty table gives empty results; other columns
of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored, unused

SPAN = "struct<start:int,end:int,kind:string>"
#: A span with its rule's place among the rules.
PLACED = "struct<start:int,order:int,end:int,kind:string>"


@dataclass(frozen=True)
class Rule:
    """least: shortest allowed length of the group; hint: a regular expression every match needs, or None."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A PEM key: to its END line if no other run of five dashes comes first, else over header lines, base64 words of 16
# letters or more and the lines of base64 after them. No lookahead, for the SQL's engine has none, and no group that is
# repeated often, for Java's engine takes stack for each time.
_SPACE, _BASE64 = r"[\x20\x09-\x0D\\]", "[A-Za-z0-9+/=_]"
_KEY_TO_END = r"[^-]*(?:-{1,4}[^-]+){0,40}-----END [A-Z ]*PRIVATE KEY-----"
_KEY_LINES = rf"(?:{_SPACE}*n?(?:Proc-Type|DEK-Info):\x20*[^\x20\x09-\x0D\\]+){{0,4}}(?:(?:{_SPACE}*{_BASE64 * 16}{_BASE64}*){{1,256}}(?:\r?\n[A-Za-z0-9+/=_\r\n]*(?:[\r\n]|\z))?)?"

# The three base kinds, then further credential formats.
RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, "[:=]", True),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hint="AKIA", base=True),
    Rule("hex", 1, r"[0-9a-f]{16,}", base=True),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("private_key", 2, rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_TO_END}|{_KEY_LINES})", hint="-----BEGIN "),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("url_login", 1, r"://[^\s:@/]+:[^\s:@/]+@", hint="://"),
)


def _literal(hint: str) -> bool:
    return not any(c in hint for c in "[]()?*+\\.|")


def _spans(text: Column, rule: Rule) -> Column:
    """All spans of one rule in one text."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)

    def positions(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

        def step(acc: Column, m: Column) -> Column:
            begin = acc["at"] + F.length(m["between"])
            end = begin + F.length(m["found"])
            span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            kept = F.when(F.length(m["group"]) >= rule.least, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], kept).alias("spans"))

        return F.aggregate(parts, start, step)["spans"]

    n = F.size(found)
    parts = F.arrays_zip(found.alias("found"), groups.alias("group"), F.slice(between, 1, n).alias("between"))
    spans = F.when(n > 0, positions(parts))
    if rule.hint:
        spans = F.when(F.contains(text, F.lit(rule.hint)) if _literal(rule.hint) else text.rlike(rule.hint), spans)
    return spans


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rules, found) of (blob, text, rules): what each rule named in rules finds, rules without a find left out."""
    lists = []
    for r in rules:
        spans = F.when(F.array_contains("rules", r.key), _spans(F.col("text"), r))
        lists.append(F.struct(F.lit(r.key).alias("rule"), F.coalesce(spans, F.array().cast(f"array<{SPAN}>")).alias("spans")))
    return blobs.select("blob", "rules", F.filter(F.array(*lists), lambda x: F.size(x["spans"]) > 0).alias("found"))


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): what the current rule versions found, by start, then in the order of the rules."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    current = findings.filter(F.col("rule").isin([r.key for r in rules]))
    placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    # At most as many rows to a blob as there are rules.
    return current.select("blob", placed.alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def scan(paths: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One scanning run.

    Returns (by path: path_col, blob, spans; ledger: blob, rules; findings: blob, rule, spans), the last two for the next
    run, which needs both. Findings of a rule's older versions stay there and are not reported."""
    if (ledger is None) != (findings is None):
        raise ValueError("a ledger comes with its findings")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    versions = paths.select(F.col(path_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    key = F.coalesce(F.col("path").cast("string"), F.lit("")).alias("key")
    slim = versions.select("path", "blob")
    unseen = slim.select("blob", key).groupBy("blob").agg(F.min("key").alias("key"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        unseen = unseen.withColumn("rules", every)
    else:
        # At most one row to a blob and run.
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        unseen = unseen.join(seen, "blob", "left").select("blob", "key", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
    unseen = unseen.filter(F.size("rules") > 0)
    fetched = versions.select("blob", key, "text").join(unseen, ["blob", "key"]).dropDuplicates(["blob", "key"])
    scanned = stored(scan_blobs(fetched, rules), "secret_scan")
    new_ledger = scanned.select("blob", "rules")
    new_findings = scanned.select("blob", F.explode("found").alias("x")).select("blob", "x.rule", "x.spans")
    if ledger is not None:
        new_ledger = ledger.select("blob", "rules").unionByName(new_ledger)
        new_findings = findings.select("blob", "rule", "spans").unionByName(new_findings)
    found = stored(by_blob(new_findings, rules), "secret_spans")
    none = F.array().cast(f"array<{PLACED}>")
    by_path = slim.join(found, "blob", "left").select(F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans"))
    return by_path, new_ledger, new_findings


def scan_in_runs(paths: DataFrame, runs: int = 2, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The paths' findings from so many runs, each with the ledger and the findings of those before.

    Each run adds a share of the paths to those of the runs before, so that the last one has them all and finds most
    blobs in the ledger."""
    ledger = findings = None
    for i in range(1, runs + 1):
        arrived = paths if i == runs else paths.filter(F.pmod(F.xxhash64(path_col), F.lit(runs)) < i)
        by_path, ledger, findings = scan(arrived, path_col, text_col, ledger, findings, rules)
    return by_path


def redacted_rows(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in the text replaced by a mark, and the text's new length where that changed it."""
    text = F.col(text_col).cast("string")
    row, blob, spans = unused(docs, "__row", "__blob", "__spans")
    addressed = docs.withColumn(blob, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    _, _, findings = scan(docs.select(F.xxhash64(*docs.columns).alias(row), text.alias(text_col)), row, text_col, rules=rules)
    found = stored(by_blob(findings, rules).toDF(blob, spans), "secret_spans")
    out = addressed.join(found, blob, "left")
    changed = F.col(spans).isNotNull()
    out = out.withColumn(text_col, F.when(changed, redacted(text, F.col(spans))).otherwise(F.col(text_col)))
    if size_col and size_col in docs.columns:
        out = out.withColumn(size_col, F.when(changed, F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return out.select(*docs.columns)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    def tail(acc: Column) -> Column:
        return F.concat(acc["out"], text.substr(acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0))))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)
