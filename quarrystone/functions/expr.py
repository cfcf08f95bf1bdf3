"""Column functions: Spark expressions only, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from worst to least, and the ranks used for ordering (unknown ranks 0). Fixed values.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def mapped(value: Column, table: dict, otherwise) -> Column:
    """`value` looked up in a small table, or `otherwise`."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for key, to in reversed(list(table.items())):
        out = F.when(value == key, to).otherwise(out)
    return out


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def first_text(*cols: Column) -> Column:
    """The first that is not null or blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def severity_rank(severity: Column) -> Column:
    """5 for CRITICAL to 1 for INFO, 0 for anything else."""
    return mapped(severity, {s: 5 - i for i, s in enumerate(SEVERITIES)}, 0)


def sarif_severity(level: Column, override: Column | None = None) -> Column:
    """A non-blank override wins; else error, warning, note map to HIGH, MEDIUM, LOW and the rest to INFO."""
    named = {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "info": "INFO", "information": "INFO",
             "error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "INFO"}
    word = F.lower(blank_to_null(level) if override is None else first_text(override, level))
    return mapped(word, named, "INFO")


def semgrep_level(severity: Column) -> Column:
    low = F.lower(F.trim(severity))
    return F.when(low.isin("critical", "error", "high"), "error").when(low.isin("warning", "medium"), "warning").otherwise("note")


def trivy_severity(severity: Column) -> Column:
    up = F.upper(F.trim(severity))
    return F.when(up.isin(*SEVERITIES), up).otherwise("INFO")


def sca_issue_key(vuln: Column, package: Column, version: Column, purl: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (vuln, package, version, purl)]), 256)


def ide_fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in parts]), 256)


def dedupe_key(project: Column, provider: Column, ids: Column, other_ids: Column | None = None) -> Column:
    """SHA-256 of project, lower-cased provider and the sorted ids, a part for the second kind of ids only if there are any."""
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    base = F.concat_ws("|", project.cast("string"), F.lower(provider), listed(ids))
    if other_ids is not None:
        base = F.when(F.size(other_ids) > 0, F.concat_ws("|", base, listed(other_ids))).otherwise(base)
    return F.sha2(base, 256)


# Package URLs -----------------------------------------------------------------------------------


def purl_plain(purl: Column) -> Column:
    """Without qualifiers and subpath."""
    return F.regexp_replace(purl, r"[?#].*$", "")


def purl_type(purl: Column) -> Column:
    return F.nullif(F.regexp_extract(purl, r"^pkg:([^/]+)/", 1), F.lit(""))


def purl_version(purl: Column) -> Column:
    """What follows the last @."""
    return F.nullif(F.regexp_extract(purl_plain(purl), r"@([^@/]+)$", 1), F.lit(""))


def purl_path(purl: Column) -> Column:
    """Namespace and name, without type and version."""
    return F.regexp_replace(F.regexp_replace(purl_plain(purl), r"^pkg:[^/]+/", ""), r"@[^@/]+$", "")


def purl_name(purl: Column) -> Column:
    return F.element_at(F.split(purl_path(purl), "/"), -1)


def purl_namespace(purl: Column) -> Column:
    parts = F.split(purl_path(purl), "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def _listed(*cols: Column) -> Column:
    low = F.transform(F.array(*cols), lambda c: F.lower(F.trim(c)))
    return F.array_distinct(F.filter(low, lambda c: c.isNotNull() & (c != "")))


def purl_match_keys(purl: Column, package: Column, component: Column) -> Column:
    """Keys under which usage evidence of a package may be listed, without repeats, blanks dropped."""
    kind, path = F.lower(purl_type(purl)), F.regexp_replace(purl_plain(purl), r"^pkg:[^/]+/", "")
    bare = F.element_at(F.split(path, "@"), 1)  # before the first @: empty for @scope/x
    parts = F.split(bare, "/")
    maven = (kind == "maven") & (F.size(parts) >= 2)
    group, artifact = F.element_at(parts, 1), F.get(parts, F.lit(1))
    return _listed(
        purl, package, component, purl_plain(purl),
        F.when(maven, F.concat_ws(":", group, artifact)), F.when(maven, group), F.when(maven, artifact),
        F.when(kind.isin("npm", "golang"), bare),
    )


def package_keys(name: Column) -> Column:
    """The name; for either separator (: and /) in it, its last part and its parts joined by the other one."""
    n = F.lower(F.trim(name))

    def swapped(sep: str, to: str) -> list[Column]:
        parts = F.filter(F.split(n, sep), lambda p: p != "")
        return [F.when(F.contains(n, F.lit(sep)), F.try_element_at(parts, F.lit(-1))), F.when(F.contains(n, F.lit(sep)) & (F.size(parts) >= 2), F.array_join(parts, to))]

    return _listed(n, *swapped(":", "/"), *swapped("/", ":"))


def node_keys(name: Column, purl: Column) -> Column:
    """Keys of a dependency-graph node: those of its name, and name and namespace:name, namespace/name of its purl."""
    ns, short = F.lower(purl_namespace(purl)), F.lower(purl_name(purl))
    parsed = F.startswith(F.trim(purl), F.lit("pkg:"))
    of_purl = F.when(parsed, _listed(short, F.concat_ws(":", ns, short), F.when(ns.isNotNull(), F.concat_ws("/", ns, short)))).otherwise(package_keys(purl))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(package_keys(name), empty), F.coalesce(of_purl, empty)))


def ecosystem(purl: Column, kind: Column) -> Column:
    return F.coalesce(F.lower(purl_type(purl)), F.lower(F.trim(kind)))


def usage_tokens(purl: Column, package: Column) -> Column:
    """Words that show the use of a package in source: 4 characters or more, Maven groups with a dot, artifacts of 6 or more."""
    kind, path = F.lower(purl_type(purl)), F.lower(purl_path(purl))
    parts = F.split(path, "/")
    group, artifact = F.element_at(parts, 1), F.element_at(parts, -1)
    maven = kind == "maven"
    picked = F.array(
        F.lower(F.trim(package)),
        F.when(maven & F.contains(group, F.lit(".")), group), F.when(maven & (F.length(artifact) >= 6), artifact),
        F.when(kind.isin("golang", "npm"), path),
    )
    return F.array_distinct(F.filter(picked, lambda t: t.isNotNull() & (F.length(t) >= 4)))


# Paths and texts --------------------------------------------------------------------------------


def rewrite_uri(uri: Column, prefix: str | Column, root: str = "/src/") -> Column:
    """Container and relative URIs under the workspace prefix; other schemes and absolute paths as they are."""
    base = F.lit(prefix.rstrip("/") + "/") if isinstance(prefix, str) else F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"))
    return (
        F.when(F.startswith(uri, F.lit("file://" + root)), F.concat(base, F.substring(uri, len("file://" + root) + 1, 1 << 30)))
        .when(F.startswith(uri, F.lit(root)), F.concat(base, F.substring(uri, len(root) + 1, 1 << 30)))
        .when(uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | F.startswith(uri, F.lit("/")), uri)
        .otherwise(F.concat(base, uri))
    )


def normalize_path(path: Column, prefix: str) -> Column:
    """Forward slashes and no workspace prefix; the trimmed original where the prefix is not there."""
    slashed, base = F.translate(F.trim(path), "\\", "/"), prefix.rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(base)), F.substring(slashed, len(base) + 1, 1 << 30)).otherwise(F.trim(path))


def line_kind(path: Column, line: Column) -> Column:
    """manifest, import or code."""
    base, text = F.lower(F.element_at(F.split(path, "/"), -1)), F.trim(line)
    manifest = base.isin("pom.xml", "package.json", "go.mod", "requirements.txt") | base.rlike(r"\.(gradle|gradle\.kts|lock)$")
    imported = text.rlike(r"^import[ \t]") | text.rlike(r"require\(|from [\"']")
    return F.when(manifest, "manifest").when(imported, "import").otherwise("code")


def dataflow_role(label: Column) -> Column:
    """source, propagator or sink when the label begins with it and a colon."""
    word = F.lower(F.trim(F.regexp_extract(label, r"^([^:]*):", 1)))
    return F.when(word.isin("source", "propagator", "sink"), F.upper(word))


def dataflow_value(label: Column) -> Column:
    """What stands between the colon and ' @', without quotes."""
    text = F.regexp_extract(label, r"^[^:]*:\s*(.*?)(?:\s@.*)?$", 1)
    return F.nullif(F.btrim(text, F.lit(" '\"`")), F.lit(""))


def has_dataflow(nodes: Column, edges: Column) -> Column:
    return (F.coalesce(F.size(nodes), F.lit(0)) > 0) | (F.coalesce(F.size(edges), F.lit(0)) > 0)


def term_score(text: Column, tokens: list[str]) -> Column:
    """Sum of non-overlapping, case-insensitive occurrences of the tokens."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for t in tokens:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("int")
    return total


def match_snippet(text: Column, tokens: list[str], before: int = 80, after: int = 160) -> Column:
    """Around the first token, in token order, that occurs; else the first `after` characters. Line ends become blanks."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\n", " ")
    low = F.lower(flat)
    at = F.coalesce(*[F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in tokens]) if tokens else F.lit(None).cast("int")
    start, end = F.greatest(at - before, F.lit(1)), F.least(at + after - 1, F.length(flat))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(flat, start, end - start + 1), F.when(end < F.length(flat), "…").otherwise(""))
    return F.when(at.isNull(), F.substring(flat, 1, after)).otherwise(cut)


def text_search(cols: list[Column], term: str | None) -> Column:
    """Any column contains the term, case-insensitively; % and _ in the term are wildcards; a blank term matches all."""
    if term is None or not term.strip():
        return F.lit(True)
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(c).like(f"%{term.strip().lower()}%"), F.lit(False))
    return hit


def log_visible(level: Column, wanted: str) -> Column:
    """ALL; ERROR: only ERROR; WARN: everything but INFO. A null level is INFO."""
    own = F.upper(F.coalesce(level, F.lit("INFO")))
    return {"ALL": F.lit(True), "ERROR": own == "ERROR"}.get(wanted.upper(), own != "INFO")


def parse_window(window: str | None) -> tuple[int, str]:
    """'7d' or '12h' -> (7, 'DAY') or (12, 'HOUR'); a bad number is 7, anything else is seven days."""
    text = (window or "").strip().lower()
    unit = {"d": "DAY", "h": "HOUR"}.get(text[-1:])
    if unit is None:
        return 7, "DAY"
    return (int(text[:-1]) if text[:-1].isdigit() and int(text[:-1]) > 0 else 7), unit


# Reviews ----------------------------------------------------------------------------------------


def normalize_verdict(verdict: Column) -> Column:
    up = F.upper(F.trim(verdict))
    return F.when(up.isin("TRUE_POSITIVE", "FALSE_POSITIVE", "UNCERTAIN"), up).otherwise("UNCERTAIN")


def normalize_status(status: Column) -> Column:
    up = F.upper(F.trim(status))
    return F.when(up.isin("CONFIRMED", "FALSE_POSITIVE"), up)


def normalize_confidence(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.try_cast("double")))


def review_type(kind: Column, reviewer: Column) -> Column:
    return F.coalesce(F.upper(blank_to_null(kind)), F.when(F.upper(F.trim(reviewer)) == "AI", "AI").otherwise("HUMAN"))


def stage_event(status: Column) -> Column:
    return mapped(status, {"RUNNING": "StageStarted", "SUCCEEDED": "StageCompleted", "FAILED": "StageFailed"}, "StageUpdated")


def stage_signal(needs_review: Column, risk: Column, auto_fix: Column) -> Column:
    """No review flag: INFO; else a risk over 0.8: HIGH; else an automatic fix: LOW; else nothing."""
    return F.when(~F.coalesce(needs_review, F.lit(False)), "INFO").when(risk > 0.8, "HIGH").when(F.coalesce(auto_fix, F.lit(False)), "LOW")


def artifact_path(artifacts: Column, prefix: str) -> Column:
    """The first artifact with the prefix, without it."""
    hit = F.get(F.filter(artifacts, lambda a: F.startswith(a, F.lit(prefix))), F.lit(0))
    return F.substring(hit, len(prefix) + 1, 1 << 30)


def method_ref(cls: Column, name: Column, arity: Column) -> Column:
    return F.concat(cls, F.lit("#"), name, F.lit("/"), arity.cast("string"))


def parse_method_ref(ref: Column) -> Column:
    """(cls, name, arity) around the last # and /; null where the text is no reference."""
    at = lambda g: F.regexp_extract(ref, r"^(.*)#([^#]*)/(\d+)$", g)
    return F.when(ref.rlike(r"^.+#[^#]*/\d+$"), F.struct(at(1).alias("cls"), at(2).alias("name"), at(3).cast("int").alias("arity")))


def package_key(cls: Column, parts: int = 2) -> Column:
    return F.array_join(F.slice(F.split(cls, r"\."), 1, parts), ".")


def heap_token(base: Column, field: Column) -> Column:
    return F.concat(base, F.lit("."), field)


def parse_heap_token(token: Column) -> Column:
    """(base, field) around the last dot; a token without a dot has no field."""
    field = F.when(F.contains(token, F.lit(".")), F.substring_index(token, ".", -1))
    base = F.when(field.isNotNull(), F.regexp_replace(token, r"\.[^.]*$", "")).otherwise(token)
    return F.struct(base.alias("base"), field.alias("field"))


def pick_i18n(en: Column, zh: Column, otherwise: Column) -> Column:
    return F.coalesce(blank_to_null(en), blank_to_null(zh), otherwise)


def best_cvss(scores: Column) -> Column:
    """scores: array of (source, score). The highest score, of ties the first; null scores count as 0."""
    score = lambda s: F.coalesce(s["score"], F.lit(0.0))
    return F.reduce(F.slice(scores, 2, 1 << 20), F.get(scores, F.lit(0)), lambda a, s: F.when(score(s) > score(a), s).otherwise(a))


def introduced_by(commit: Column, image: Column, path: Column, upload: Column, url: Column, ref: Column) -> Column:
    """The first that is there: commit, image, file system path, uploaded or linked SBOM, source reference."""
    marked = lambda c: F.concat(F.lit("sbom:"), blank_to_null(c))
    return F.coalesce(blank_to_null(commit), blank_to_null(image), blank_to_null(path), marked(upload), marked(url), blank_to_null(ref))


def review_fields(result: Column) -> Column:
    """(verdict, reason, confidence, status) of a review's JSON text; the summary stands before the reason, a
    suggested status before the one of the first recommended finding."""
    v = F.try_parse_json(result)
    text = lambda path: blank_to_null(F.try_variant_get(v, path, "string"))
    return F.struct(
        text("$.verdict").alias("verdict"), F.coalesce(text("$.summary"), text("$.reason")).alias("reason"), F.try_variant_get(v, "$.confidence", "double").alias("confidence"),
        F.coalesce(text("$.suggestedStatus"), text("$.recommendation.findings[0].status")).alias("status"),
    )


def snippet_lines(lines: Column, start: Column, end: Column, most: int = 200, width: int = 400) -> Column:
    """Lines start to end (from 1) of an array, at most `most`, cut to `width`; null where the range is not valid."""
    fine = (start >= 1) & (end >= start) & (F.size(lines) >= start)
    return F.when(fine, F.transform(F.slice(lines, start, F.least(end - start + 1, F.lit(most))), lambda x: F.substring(x, 1, width)))


def ticket_description(en: Column, zh: Column, titles: Column) -> Column:
    """The given text, else a list of the items."""
    return pick_i18n(en, zh, F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n"))


SNIPPET = "STRUCT<path: STRING, startLine: INT, endLine: INT, lines: ARRAY<STRUCT<lineNumber: INT, content: STRING, highlight: BOOLEAN>>>"


def dataflow_snippet(evidence: Column, path: Column, line: Column, most: int = 200, width: int = 400) -> Column:
    """(path, start_line, end_line, lines) of the first dataflow node of an evidence text at (path, line), or null: the node's own
    snippet where it is valid, else its value as the one line, highlighted."""
    flow = F.coalesce(F.get_json_object(evidence, "$.dataflow"), F.get_json_object(evidence, "$.dataFlow"))
    nodes = F.from_json(flow, f"nodes ARRAY<STRUCT<file: STRING, line: INT, value: STRING, codeSnippet: {SNIPPET}>>")["nodes"]
    node = F.get(F.filter(nodes, lambda n: (n["file"] == path) & (n["line"] == line)), F.lit(0))
    own = node["codeSnippet"]
    kept = F.filter(own["lines"], lambda x: x["lineNumber"].isNotNull() & x["content"].isNotNull())
    one = lambda number, content, lit: F.struct(number.alias("line_number"), F.substring(content, 1, width).alias("content"), lit.alias("highlight"))
    said = F.transform(F.slice(kept, 1, most), lambda x: one(x["lineNumber"], x["content"], F.coalesce(x["highlight"], F.lit(False))))
    fine = (F.trim(own["path"]) != "") & (own["startLine"] > 0) & (own["endLine"] >= own["startLine"]) & (F.size(kept) > 0)
    part = lambda p, a, b, lines: F.struct(p.alias("path"), a.alias("start_line"), b.alias("end_line"), lines.alias("lines"))
    text = node["value"]
    return F.when(fine, part(F.trim(own["path"]), own["startLine"], own["endLine"], said)).when(F.trim(F.substring(text, 1, width)) != "", part(path, line.cast("int"), line.cast("int"), F.array(one(line.cast("int"), text, F.lit(True)))))
