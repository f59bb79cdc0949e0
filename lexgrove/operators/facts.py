"""Case facts, timelines, redaction with stable tokens, templates, access, files and activity."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.text import PII_KINDS, atoms, fact_value, holds_quote

ROLES = ("viewer", "editor", "owner")
DATED_ROLES = ("act_received", "decision_received", "decision_date", "complaint_decision_date")
PLACEHOLDER = re.compile(r"\{\{\s*([\w.]+)\s*(?:\|([^}]*))?\}\}")


def admit(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """facts with value and accepted: the value must parse, and an agent's fact needs a verbatim quote of its source."""
    rows = facts.join(sources.select("source_path", F.col("text").alias("__text")), "source_path", "left").withColumn("value", fact_value("kind", "text"))
    quoted = F.when(F.col("extracted_by") == "agent", holds_quote("__text", "quote")).otherwise(F.lit(True))
    return rows.withColumn("accepted", F.col("value").isNotNull() & quoted).drop("__text")


def timeline(facts: DataFrame) -> DataFrame:
    """Dated facts by start, then end (none first), then identifier."""
    start = F.when(F.col("kind") == "period", F.substring_index("value", "..", 1)).otherwise(F.col("value"))
    end = F.when(F.col("kind") == "period", F.substring_index("value", "..", -1))
    rows = facts.where(F.col("kind").isin("date", "event", "period")).withColumn("start", start.cast("date")).withColumn("end", end.cast("date"))
    return rows.orderBy("start", F.coalesce(F.col("end").cast("string"), F.lit("")), "fact_id")


def case_dates(facts: DataFrame) -> DataFrame:
    """workspace, act_received, decision_received, ..: the first confirmed fact of each role, as the calculators take them."""
    rows = facts.where(F.col("confirmed") & F.col("role").isin(*DATED_ROLES))
    return rows.groupBy(F.col("workspace").alias("case_id")).pivot("role", list(DATED_ROLES)).agg(F.min_by(F.col("value").cast("date"), "fact_id"))


def redact(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, tokens map: every personal value replaced by [KIND-n], equal values by equal tokens, n by first place.

    Where the text holds tokens of its own, n goes on behind the largest of them, so ``restore`` undoes it exactly. A text
    is its own scope, so this is a projection of built-in functions. It costs far more than reading, so the texts are dealt
    to all tasks first: a few narrow columns in one file would be one task.
    """
    held = F.regexp_extract_all("__t", F.lit(rf"\[(?:{'|'.join(PII_KINDS)})-(\d{{1,9}})\]"), F.lit(1))
    base = texts.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t")).repartition(key, "__t")
    base = base.select(key, atoms("__t").alias("__atoms"), F.coalesce(F.array_max(F.transform(held, lambda n: n.cast("int"))), F.lit(0)).alias("__from"))
    listed = base.withColumn("__own", F.array_distinct(F.filter("__atoms", lambda a: a["kind"].isNotNull())))
    # a value's number: how many values of its kind come up to it
    place = lambda e, i: F.col("__from") + F.size(F.filter(F.slice("__own", 1, i + 1), lambda o: o["kind"] == e["kind"]))
    named = listed.withColumn("__tokens", F.transform("__own", lambda e, i: F.concat(F.lit("["), e["kind"], F.lit("-"), place(e, i).cast("string"), F.lit("]"))))
    token = lambda a: F.element_at("__tokens", F.array_position(F.col("__own"), a).cast("int"))
    said = F.array_join(F.transform("__atoms", lambda a: F.when(a["kind"].isNull(), a["value"]).otherwise(token(a))), "")
    return named.select(key, said.alias(text), F.map_from_arrays("__tokens", F.transform("__own", lambda e: e["value"])).alias("tokens"))


def restore(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts(text, tokens) with every token replaced by its value; no token is part of another."""
    put = F.reduce(F.map_entries("tokens"), F.col(text), lambda acc, e: F.replace(acc, e["key"], e["value"]))
    return texts.withColumn(text, put)


def visible(rows: DataFrame, members: DataFrame, email: str, needed: str = "viewer", slug: str = "slug") -> DataFrame:
    """Rows of workspaces in which a member has the needed role or a higher one; admins see all."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    own = members.where(F.col("email") == email)
    may = own.where(rank[F.col("role")] >= ROLES.index(needed)).select(F.col("slug").alias("__slug"))
    admin = own.where("role = 'admin'").limit(1).agg((F.count(F.lit(1)) > 0).alias("__admin"))  # one row
    joined = rows.join(may.distinct(), F.col(slug) == F.col("__slug"), "left").crossJoin(F.broadcast(admin))
    return joined.where(F.col("__admin") | F.col("__slug").isNotNull()).drop("__slug", "__admin")


def required_role(method: Column, path: Column) -> Column:
    """Reading needs a viewer, members and deletions an owner, other writing an editor."""
    return F.when(method == "GET", "viewer").when(path.contains("/members") | (method == "DELETE"), "owner").otherwise("editor")


def file_versions(old: DataFrame, written: DataFrame) -> DataFrame:
    """old(slug, path, version, content) with the new contents appended as their next versions."""
    last = old.groupBy("slug", "path").agg(F.max("version").alias("__v"))
    new = written.join(last, ["slug", "path"], "left").withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v")
    return old.unionByName(new.select(*old.columns))


def mirror(stored: DataFrame, folder: DataFrame, keys: list[str]) -> DataFrame:
    """What a store should hold after a sync: the folder's rows, with the stored row kept where nothing differs; vanished rows go."""
    same = [c for c in folder.columns if c not in keys]
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}"))
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = folder.alias("f").join(stored.alias("s"), on, "left")
    return joined.select(*[F.col(f"f.{c}").alias(c) for c in folder.columns], F.when(F.col(f"s.{keys[0]}").isNull(), "added").when(differs, "changed").otherwise("same").alias("sync"))


def threads(comments: DataFrame) -> DataFrame:
    """thread_id, n, last, resolved of comments(comment_id, parent_id, at, resolved): a resolved root closes its branch."""
    rooted = comments.withColumn("thread_id", F.coalesce("parent_id", "comment_id"))
    return rooted.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.max(F.when(F.col("parent_id").isNull(), F.col("resolved"))).alias("resolved"))


def recent(activity: DataFrame, n: int = 50) -> DataFrame:
    """The latest n entries of an append-only log, doubles left out."""
    return activity.dropDuplicates(["slug", "actor", "kind", "target", "at"]).orderBy(F.col("at").desc(), "target").limit(n)


def front_matter(text: str) -> tuple[dict, str]:
    """(header, body) of a file that opens with 'key: json' lines between '---' marks."""
    if not text.startswith("---\n") or "\n---\n" not in text[4:]:
        return {}, text
    head, body = text[4:].split("\n---\n", 1)
    out = {}
    for line in head.splitlines():
        key, _, value = line.partition(":")
        try:
            out[key.strip()] = json.loads(value)
        except ValueError:
            out[key.strip()] = value.strip()
    return out, body


def render(body: str, values: dict[str, str]) -> tuple[str, list[str]]:
    """(text, missing keys): placeholders {{key|fallback}} filled; one without value or fallback shows [[нет: key]]."""
    missing: list[str] = []

    def put(m: re.Match) -> str:
        value = values.get(m.group(1))
        if value is not None:
            return value
        if m.group(2) is not None:
            return m.group(2)
        missing.append(m.group(1))
        return f"[[нет: {m.group(1)}]]"

    return PLACEHOLDER.sub(put, body), missing


def render_all(drafts: DataFrame) -> DataFrame:
    """drafts(draft_id, body, values map) -> draft_id, text, missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render(t or "", dict(v or [])) for t, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=["draft_id", "text", "missing"])

    return drafts.select(F.col("draft_id").cast("string"), "body", "values").mapInArrow(run, "draft_id string, text string, missing array<string>")


def placeholders(templates: DataFrame) -> DataFrame:
    return templates.select("name", F.size(F.regexp_extract_all("body", F.lit(r"(\{\{[^}]+\}\})"), F.lit(1))).alias("placeholders"), F.size(F.regexp_extract_all("body", F.lit(r"(?m)(^#+\s)"), F.lit(1))).alias("sections"))


def highlight(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Escaped HTML with marks over the spans (start, end, class); overlapping ones after the first are left out."""
    out, at = [], 0
    for start, end, name in sorted(spans):
        if start >= at:
            out += [html.escape(text[at:start]), f'<mark class="{html.escape(name)}">{html.escape(text[start:end])}</mark>']
            at = end
    return "".join([*out, html.escape(text[at:])])


def json_block(text: str | Column) -> Column:
    """The first {...} of a text as a variant, NULL where it is not JSON."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))
