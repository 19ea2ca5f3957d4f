"""Queries over stores, references, audits and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import failures as X
from ..functions.gate import normal_completion
from ..functions.text import NON_ASCII, has_script, overlay
from ..operators import audit as A
from ..operators import reconcile as R
from ..operators.boards import all_boards
from .boards import _ENTRIES_SQL
from .common import STATUSES_SQL, load, statuses


def store_merge(spark, d):
    """Documents as the store, overlaid by index rows: labels with a language override that is often empty."""
    store = load(spark, d, "documents").select("doc_id", "lang", "source")
    index = load(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("")).when(F.col("toxic") == 1, "xx").alias("lang"), F.when(F.col("quality") == 0, "index").alias("source"))
    return R.merge_overlay(store, index, "doc_id", ["lang", "source"])


def final_state_merge(spark, d):
    fetched = load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit("fetched").alias("state")).distinct()
    processed = load(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "processed").alias("state"))
    store = load(spark, d, "documents").select("doc_id", F.when(has_script("text", NON_ASCII), "stored").alias("state"))
    return R.state_counts(R.final_states(fetched, [store, processed], "doc_id"), "stored")


def _references(spark, d):
    return all_boards(load(spark, d, "events")).select("mode", "key", F.col("user_id").alias("doc_id"))


def status_precedence(spark, d):
    refs = _references(spark, d)
    own = statuses(spark, d)
    evidence = own.select("doc_id", "status").unionByName(own.filter("tainted").select("doc_id", F.lit("failed").alias("status")))
    folded = R.fold_status(evidence, "doc_id")
    return R.fan_out(refs, folded, "doc_id").withColumn("status", F.coalesce("status", F.lit("absent")))


def _gate(spark, d):
    docs = load(spark, d, "documents")
    own = statuses(spark, d)
    evidence = own.select("doc_id", ((F.col("status") == "failed") | F.col("tainted")).alias("blocked")).unionByName(docs.select("doc_id", F.contains("text", F.lit("token =")).alias("blocked")))
    return R.publication_gate(docs.select("doc_id"), evidence, "doc_id")


def publication_gate(spark, d):
    return _gate(spark, d)


def total_mismatch(spark, d):
    rows = load(spark, d, "conversations")
    return A.total_mismatch(rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("declared"), F.count(F.lit(1)).alias("actual")))


def _issues(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    return A.issues(docs, statuses(spark, d), "doc_id", "n_chars")


def audit_issues(spark, d):
    return _issues(spark, d)


def issue_counts(spark, d):
    return A.issue_counts(spark, _issues(spark, d), "doc_id")


def stats_by_mode(spark, d):
    own = statuses(spark, d)
    flags = own.select("doc_id", (F.col("status") == "failed").alias("candidate"), (F.col("status") == "ok").alias("repaired"), F.col("tainted").alias("residual"))
    return A.stats_by_mode(_references(spark, d), flags, "doc_id")


def coverage(spark, d):
    docs, own = load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels").select("doc_id")
    return A.coverage(docs, own, "doc_id", ["lang"])


def orphans(spark, d):
    lost = R.orphans(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")
    return lost.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


def change_delta(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang")
    updates = load(spark, d, "labels").select((F.col("doc_id") + F.when(F.col("toxic") == 1, 1_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("quality") == 1, "en").alias("lang"))
    return R.merge_fields(rows, updates, "doc_id", ["lang"])[1]


# The same ladder on words of the test corpus: category, family, strategy, action, pattern.
_LADDER = (
    ("secret.token", "leak", "manual_review", "revoke_token", r"token = "),
    ("secret.mail", "leak", "retry_later", "mask_address", r"[a-z0-9.]+@[a-z0-9.]+"),
    ("text.license", "boilerplate", "reuse_text", "strip_license", r"licensed under"),
    ("text.symbols", "noise", "drop_text", "drop_document", r"\*\*\* "),
    ("text.abuse", "toxic", "manual_review", "review_document", r"worthless|stupid|trash"),
)
_ELSE = ("text.clean", "none", "keep_text", "keep_document")


def _classified(spark, d):
    return load(spark, d, "documents").select("doc_id", X.ladder(F.col("text"), _LADDER, _ELSE).alias("x")).select("doc_id", "x.*")


#: Messages of failed runs, (phase, text): each rule of the two ladders has one at least, the last have none.
_MESSAGES = (
    ("translate", "insufficient_user_quota: balance 0.005 is insufficient"), ("translate", "FileNotFoundError: x\nin workfolder"), ("translate", "main source was not found"),
    ("translate", "401 Unauthorized"), ("translate", "Too Many Requests"), ("translate", "Connection timed out"), ("translate", "RuntimeError in a thread"), ("translate", "Traceback of a call"),
    ("translate", "nothing came back"), ("compile", "TeX capacity exceeded, sorry"), ("compile", "Could not find file: assets/logo.png"), ("compile", "! LaTeX Error: File `nice.sty' not found."),
    ("compile", "LaTeX Error: Environment CJK* undefined"), ("compile", 'x "translation": "\\\\section{a}"'), ("compile", 'fontspec Error: The font "SourceSans3-Bold" cannot be found'),
    ("compile", "Undefined control sequence.\n\\pdfshellescape"), ("compile", "Undefined control sequence.\nl.7 \\pdfoutput"), ("compile", "Undefined control sequence. \\endtcolorbox"),
    ("compile", "matrix of nodes"), ("compile", "Undefined control sequence.\nl.72 \\nndiff{x}"), ("compile", "Undefined control sequence.\nl.72 \\method"), ("compile", "Runaway argument?"),
    ("compile", "Illegal unit of measure"), ("compile", "Missing $ inserted"), ("compile", "LaTeX Error in lstlisting"), ("compile", "translation coverage check failed"), ("compile", "compile timed out"),
    ("compile", "Package foo Error: bad option"), ("compile", "nothing that is known"),
)


def failure_ladder(spark, d):
    """The log of a failed run for each document: its message, the first line of the text, a second message in some."""
    docs = load(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("said"))
    table = F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(m).alias("message")) for p, m in _MESSAGES))
    one, two = F.get(table, (F.col("doc_id") % len(_MESSAGES)).cast("int")), F.get(table, (F.col("doc_id") * 7 % len(_MESSAGES)).cast("int"))
    also = F.when((F.col("doc_id") % 3 == 0) & (two["phase"] == one["phase"]), F.concat(F.lit("\n"), two["message"])).otherwise("")
    log = F.concat(one["message"], F.lit("\n"), "said", also)
    logs = docs.select("doc_id", one["phase"].alias("phase"), F.when(one["phase"] == "compile", log).alias("log"), F.when(one["phase"] == "translate", log).alias("error"))
    return logs.select("doc_id", X.classify("phase", "log", "error").alias("x")).select("doc_id", "x.category", "x.family", "x.retry_strategy", "x.repair_action", "x.retryable", "x.suggestion")


def failure_classify(spark, d):
    return _classified(spark, d).select("doc_id", "category", "family", "retry_strategy", "repair_action", "retryable")


def failure_evidence(spark, d):
    return _classified(spark, d).select("doc_id", F.length("evidence").cast("long").alias("evidence_chars"), "evidence")


def failure_summary(spark, d):
    return A.failure_summary(_classified(spark, d))


#: Categories of the corpus ladder and the patches that address them.
_CATALOG = (("secret.token", "rotate_credentials"), ("secret.mail", "mask_personal_data"), ("text.license", "strip_boilerplate"), ("text.abuse", "queue_review"))


def patch_plan(spark, d):
    catalog = spark.createDataFrame(list(_CATALOG), "category string, patch string")
    return A.patch_plan(_classified(spark, d), catalog, "doc_id")


def priority_diagnosis(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.when(F.contains("text", F.lit("*** ")), 20).when(F.lower("text").contains("licensed"), 10).alias("priority"), F.lit(0).alias("pos"))
    own = load(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, 40).when(F.col("quality") == 0, 20).alias("priority"), F.lit(1).alias("pos"))
    return R.arg_max(docs.unionByName(own).filter("priority IS NOT NULL"), "doc_id", "priority", "pos")


def status_machine(spark, d):
    """One step of the status machine for every label, by event."""
    own = statuses(spark, d)
    event = F.element_at(F.array(*(F.lit(x) for x in ("taint", "verify", "set_ok", "reconcile"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return own.select("doc_id", event.alias("event"), R.next_status(F.col("status"), F.col("tainted"), event, F.col("doc_id") % 3 != 0).alias("next"))


def store_upsert(spark, d):
    """Field merge with new keys: labels into documents."""
    store = load(spark, d, "documents").select("doc_id", "lang", "source")
    changes = load(spark, d, "labels").select((F.col("doc_id") + F.when(F.col("toxic") == 1, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return R.upsert(store, changes, "doc_id")


def counter_merge(spark, d):
    """Sums of counters over documents, by source."""
    each = load(spark, d, "documents").select("source", F.col("n_chars").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return R.merge_counters(each, ["source"], ["chars", "lines"]).unpivot("source", ["chars", "lines"], "name", "n")


def _files(spark, d):
    """Three artifacts a document, as old as its id says."""
    kinds = F.array(F.lit("pdf"), F.lit("sidecar"), F.lit("failed_tex"))
    docs = load(spark, d, "documents").select("doc_id", "n_chars", F.posexplode(kinds).alias("i", "kind"))
    age = F.make_dt_interval(days=((F.col("doc_id") + F.col("i")) % 6).cast("int"))
    return docs.select("doc_id", "kind", (F.col("n_chars") + F.col("i")).alias("length"), (F.lit("2024-03-10").cast("timestamp") - age).alias("modified"))


def reclaim_counts(spark, d):
    """What a cleanup of artifacts that no board or label names would keep, remove and free."""
    references = _references(spark, d).select("doc_id").unionByName(load(spark, d, "labels").filter("quality = 1").select("doc_id"))
    return R.reclaim_counts(R.reclaimable(_files(spark, d), references, "doc_id", "modified", F.lit("2024-03-10").cast("timestamp")))


def completion_texts(spark, d):
    """The text of chat completions made of every document, in each of the forms that servers give."""
    k, said = F.col("doc_id") % 6, F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    said = F.substring(said, 6, F.length(said) - 6)  # the text as a string of JSON
    body = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    raw = (
        F.when(k == 0, body('{"choices": [{"message": {"content": ', said, "}}]}"))
        .when(k == 1, body('{"choices": [{"message": {"content": [', said, ', {"text": {"value": ', said, '}}, {"text": " "}]}}]}'))
        .when(k == 2, body('{"choices": [{"message": {"content": "", "reasoning_content": ', said, "}}]}"))
        .when(k == 3, body('{"choices": [{"message": null, "text": ', said, "}, {}]}"))
        .when(k == 4, body('{"choices": [{"message": {"content": ', said))
        .otherwise(body('{"choices": [{"message": {"content": {"text": ', said, "}}}]}"))
    )
    return load(spark, d, "documents").select("doc_id", F.sha2(normal_completion(raw), 256).alias("said"))


_DOC_GATE = "gate AS (SELECT d.doc_id, coalesce(s.status = 'failed' OR s.tainted, FALSE) OR contains(d.text, 'token =') AS blocked FROM documents d LEFT JOIN statuses s USING (doc_id))"
_CASE = " ".join(f"WHEN regexp_matches(text, '(?i){r[4]}') THEN '{r[0]}'" for r in _LADDER)
_SPEC = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', {str(r[2] != 'manual_review').upper()})" for r in (*_LADDER, _ELSE))
#: The first match of a category's pattern.
_FOUND = " ".join(f"WHEN '{r[0]}' THEN regexp_extract(text, '(?i){r[4]}')" for r in _LADDER)
_CLASSIFIED = f"""
WITH spec(category, family, retry_strategy, repair_action, retryable) AS (VALUES {_SPEC}),
c AS (SELECT doc_id, CASE {_CASE} ELSE '{_ELSE[0]}' END AS category, text FROM documents),
r AS (SELECT c.*, family, retry_strategy, repair_action, retryable FROM c JOIN spec USING (category))"""

def _ladder_sql(rules, otherwise, text: str, wide: str) -> str:
    """The first rule that matches; the engine has no reference to a group, so doubled letters are told one by one."""
    doubled = "(" + "|".join(f"{c}{c}|{c}{c.upper()}|{c.upper()}{c}|{c.upper()}{c.upper()}" for c in "abcdefghijklmnopqrstuvwxyz") + ")"
    cases = []
    for rule in rules:
        own = wide if rule[0] in X.BOTH_TEXTS else text
        tests = [p.replace("([A-Za-z])\\1", doubled).replace("'", "''") for p in rule[4:]]
        flags = ["" if p.startswith("(?-i)") else "(?i)" for p in tests]
        cases.append("WHEN " + " AND ".join(f"regexp_matches({own}, '{f}{p.removeprefix('(?-i)')}')" for f, p in zip(flags, tests)) + f" THEN '{rule[0]}'")
    return f"CASE {' '.join(cases)} ELSE '{otherwise[0]}' END"


_EVERY = (*X.TRANSLATE_LADDER, X.TRANSLATE_ELSE, *X.COMPILE_LADDER, X.COMPILE_ELSE)
_EVERY_SPEC = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', {str(r[2] != 'manual_review').upper()}, '{X.SUGGESTIONS[r[0]]}')" for r in _EVERY)
_SAID = ", ".join("('{}', '{}')".format(p, m.replace("'", "''")) for p, m in _MESSAGES)

QUERIES = {
    "store_merge": store_merge,
    "final_state_merge": final_state_merge,
    "status_precedence": status_precedence,
    "publication_gate": publication_gate,
    "total_mismatch": total_mismatch,
    "audit_issues": audit_issues,
    "issue_counts": issue_counts,
    "stats_by_mode": stats_by_mode,
    "coverage": coverage,
    "orphans": orphans,
    "change_delta": change_delta,
    "failure_classify": failure_classify,
    "failure_ladder": failure_ladder,
    "failure_evidence": failure_evidence,
    "failure_summary": failure_summary,
    "patch_plan": patch_plan,
    "priority_diagnosis": priority_diagnosis,
    "status_machine": status_machine,
    "store_upsert": store_upsert,
    "counter_merge": counter_merge,
    "reclaim_counts": reclaim_counts,
    "completion_texts": completion_texts,
}

_ISSUES = f"""
WITH {STATUSES_SQL}, j AS (SELECT d.doc_id, n_chars, s.doc_id IS NULL AS lost, status, coalesce(tainted, FALSE) AS tainted FROM documents d LEFT JOIN statuses s USING (doc_id)),
i AS (
  SELECT doc_id, 'missing_store' AS issue FROM j WHERE lost UNION ALL
  SELECT doc_id, 'failed_status' FROM j WHERE status = 'failed' UNION ALL
  SELECT doc_id, 'tainted' FROM j WHERE tainted UNION ALL
  SELECT doc_id, 'ok_missing_file' FROM j WHERE status = 'ok' AND n_chars < 200
)"""

ORACLE_SQL = {
    "failure_ladder": f"""
WITH spec(category, family, retry_strategy, repair_action, retryable, suggestion) AS (VALUES {_EVERY_SPEC}),
msg AS (SELECT row_number() OVER () - 1 AS k, phase, message FROM (VALUES {_SAID}) v(phase, message)),
l AS (SELECT doc_id, a.phase, a.message || chr(10) || string_split(text, chr(10))[1] || CASE WHEN doc_id % 3 = 0 AND a.phase = b.phase THEN chr(10) || b.message ELSE '' END AS log
  FROM documents JOIN msg a ON a.k = doc_id % {len(_MESSAGES)} JOIN msg b ON b.k = doc_id * 7 % {len(_MESSAGES)}),
c AS (SELECT doc_id, CASE WHEN phase = 'translate' THEN {_ladder_sql(X.TRANSLATE_LADDER, X.TRANSLATE_ELSE, "log", "log")} ELSE {_ladder_sql(X.COMPILE_LADDER, X.COMPILE_ELSE, "log", "log")} END AS category FROM l)
SELECT doc_id, category, family, retry_strategy, repair_action, retryable, suggestion FROM c JOIN spec USING (category)""",
    "store_merge": """
SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN NULL WHEN toxic = 1 THEN 'xx' END, lang) AS lang, coalesce(CASE WHEN quality = 0 THEN 'index' END, source) AS source
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "final_state_merge": """
SELECT final, count(*) AS attempted, count(*) FILTER (WHERE final = 'stored') AS succeeded FROM (
  SELECT coalesce(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'stored' END, CASE WHEN quality = 1 THEN 'processed' END, 'fetched') AS final
  FROM (SELECT DISTINCT user_id AS doc_id FROM events) e LEFT JOIN labels USING (doc_id) LEFT JOIN documents USING (doc_id)) GROUP BY final""",
    "status_precedence": f"""
WITH {STATUSES_SQL}, f AS (SELECT doc_id, CASE WHEN bool_or(status = 'failed' OR tainted) THEN 'failed' WHEN bool_or(status = 'ok') THEN 'ok' ELSE 'absent' END AS status FROM statuses GROUP BY doc_id)
SELECT mode, key, user_id AS doc_id, coalesce(status, 'absent') AS status FROM ({_ENTRIES_SQL}) e LEFT JOIN f ON f.doc_id = e.user_id""",
    "publication_gate": f"WITH {STATUSES_SQL}, {_DOC_GATE} SELECT doc_id, blocked FROM gate",
    "total_mismatch": "SELECT conv_id, declared, actual, declared IS DISTINCT FROM actual AS mismatch FROM (SELECT conv_id, max(turn) + 1 AS declared, count(*) AS actual FROM conversations GROUP BY conv_id)",
    "audit_issues": f"{_ISSUES} SELECT doc_id, issue FROM i",
    "issue_counts": f"""{_ISSUES}
SELECT issue, count(doc_id) AS n, count(DISTINCT doc_id) AS items
FROM (VALUES ('missing_store'), ('failed_status'), ('tainted'), ('ok_missing_file'), ('bad_record')) v(issue) LEFT JOIN i USING (issue) GROUP BY issue""",
    "stats_by_mode": f"""
WITH {STATUSES_SQL} SELECT mode, count(DISTINCT user_id) AS ids, count(DISTINCT CASE WHEN status = 'failed' THEN user_id END) AS candidates,
  count(DISTINCT CASE WHEN status = 'ok' THEN user_id END) AS repaired, count(DISTINCT CASE WHEN tainted THEN user_id END) AS residual
FROM ({_ENTRIES_SQL}) e LEFT JOIN statuses s ON s.doc_id = e.user_id GROUP BY mode""",
    "coverage": """
SELECT lang, count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS uncovered, round(100.0 * count(l.doc_id)::DOUBLE / greatest(count(*), 1)::DOUBLE, 1) AS pct
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang""",
    "orphans": "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
    "change_delta": """
WITH u AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN quality = 1 THEN 'en' END AS lang FROM labels)
SELECT (SELECT count(*) FROM documents d JOIN u USING (doc_id) WHERE u.lang <> d.lang) AS changed, (SELECT count(*) FROM documents JOIN u USING (doc_id)) AS matched,
  (SELECT count(*) FROM u WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS missing""",
    "failure_classify": f"{_CLASSIFIED} SELECT doc_id, category, family, retry_strategy, repair_action, retryable FROM r",
    "failure_evidence": f"""{_CLASSIFIED}, m AS (SELECT doc_id, text, CASE category {_FOUND} ELSE '' END AS hit FROM r),
p AS (SELECT *, greatest(strpos(text, hit) - 100, 1) AS begin FROM m),
e AS (
  SELECT doc_id, CASE WHEN hit = '' THEN left(coalesce(text, ''), 500)
    ELSE left(trim(regexp_replace(substr(text, begin, strpos(text, hit) + length(hit) + 180 - begin), '\\s+', ' ', 'g')), 500) END AS evidence FROM p)
SELECT doc_id, length(evidence) AS evidence_chars, evidence FROM e""",
    "failure_summary": f"{_CLASSIFIED} SELECT category, retry_strategy, count(*) AS n FROM r GROUP BY GROUPING SETS ((category), (retry_strategy), ())",
    "patch_plan": f"""{_CLASSIFIED}
SELECT category, patch, min(doc_id) AS first_seen, count(*) AS n FROM r JOIN (VALUES {", ".join(f"('{c}', '{p}')" for c, p in _CATALOG)}) v(category, patch) USING (category) GROUP BY ALL""",
    "priority_diagnosis": """
SELECT doc_id, priority, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, pos) AS n FROM (
    SELECT doc_id, CASE WHEN contains(text, '*** ') THEN 20 WHEN contains(lower(text), 'licensed') THEN 10 END AS priority, 0 AS pos FROM documents UNION ALL
    SELECT doc_id, CASE WHEN toxic = 1 THEN 40 WHEN quality = 0 THEN 20 END, 1 FROM labels
  ) WHERE priority IS NOT NULL) WHERE n = 1""",
    "status_machine": f"""
WITH {STATUSES_SQL}, e AS (SELECT *, (['taint', 'verify', 'set_ok', 'reconcile'])[doc_id % 4 + 1] AS event, doc_id % 3 <> 0 AS ok FROM statuses)
SELECT doc_id, event, CASE event WHEN 'taint' THEN 'failed' WHEN 'verify' THEN CASE WHEN ok THEN 'ok' ELSE 'failed' END
  WHEN 'set_ok' THEN CASE WHEN tainted THEN status ELSE 'ok' END ELSE CASE WHEN status = 'failed' AND ok AND NOT tainted THEN 'ok' ELSE status END END AS next FROM e""",
    "store_upsert": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, source) AS source
FROM documents d FULL JOIN (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000000 ELSE 0 END AS doc_id, toxic FROM labels) l ON d.doc_id = l.doc_id""",
    "counter_merge": """
SELECT source, 'chars' AS name, sum(n_chars)::BIGINT AS n FROM documents GROUP BY source UNION ALL
SELECT source, 'lines', sum(len(string_split(text, chr(10))))::BIGINT FROM documents GROUP BY source""",
    "reclaim_counts": f"""
WITH held AS (SELECT user_id AS doc_id FROM ({_ENTRIES_SQL}) UNION SELECT doc_id FROM labels WHERE quality = 1),
f AS (SELECT doc_id, kind, n_chars + i AS length, (doc_id + i) % 6 AS age, doc_id IN (SELECT doc_id FROM held) AS held FROM documents, (VALUES (0, 'pdf'), (1, 'sidecar'), (2, 'failed_tex')) k(i, kind))
SELECT kind, count(*) FILTER (age < 3) AS kept_recent, count(*) FILTER (age >= 3 AND held) AS kept_referenced, count(*) FILTER (age >= 3 AND NOT held) AS would_remove,
  coalesce(sum(length) FILTER (age >= 3 AND NOT held), 0)::BIGINT AS would_free_bytes FROM f GROUP BY kind""",
    "completion_texts": """
SELECT doc_id, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN NULL
  WHEN doc_id % 6 IN (0, 2, 3) THEN sha256(text) WHEN doc_id % 6 = 1 THEN sha256(text || chr(10) || text) END AS said FROM documents""",
}
