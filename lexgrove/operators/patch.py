"""Amending laws: text to instructions, instructions to new unit texts, failures to a queue.

Instructions see the effects of earlier ones on their article, so an article's units and instructions meet in one
group; an act's articles are dealt to ``PARTS`` groups, and those that inserted articles link to one more. Reading a law
is a walk over its items with the address carried from a heading to its sub-items.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import word_date
from lexgrove.operators.citations import NUMBER, ordinal_value
from lexgrove.sources.shared import written

QUOTES = str.maketrans("«»„“”", '"""""')
INSTRUCTIONS = "act string, law string, nth int, operation string, article string, point string, subpoint string, paragraph int, old string, new string, new_kind string, new_number string, raw string"
RESULTS = "act string, law string, nth int, operation string, status string, unit_id string, reason string, old_text string, new_text string, diff string"
#: What an instruction does, by the phrase in it; the first that fits counts.
PHRASES = (
    ("repeal", re.compile(r"утративш\w*\s+силу")),
    ("delete_paragraph", re.compile(r"^(?!.*слова).*абзац\w*\s+\w+.*исключить")),
    ("replace", re.compile(r"изложить в следующей редакции")),
    ("insert_unit", re.compile(rf"дополнить (?P<kind>пунктом|подпунктом|стать[её]й) (?P<number>{NUMBER}) следующего содержания")),
    ("insert_paragraph", re.compile(r"дополнить абзацем следующего содержания")),
    ("replace_words", re.compile(r"слова .*заменить словами")),
    ("insert_words", re.compile(r"(?:после слов .*)?дополнить словами")),
    ("delete_words", re.compile(r"слова .*исключить")),
)
NEW_KINDS = {"пунктом": "point", "подпунктом": "subpoint"}
#: Groups that an act's articles are dealt to, and what of a unit's path below its act tells the article.
PARTS = 16
ARTICLE = r"^(?:\.(?:ch|r|sub)[\w-]+)?\.art([^.]+)"


@dataclass
class Address:
    article: str | None = None
    point: str | None = None
    subpoint: str | None = None
    paragraph: int | None = None

    def refine(self, text: str) -> Address:
        """This address, narrowed by the units named in text; a wider unit clears those inside it."""
        low, out = text.lower(), Address(self.article, self.point, self.subpoint)
        for name, word, inner in (("article", r"стать\w", ("point", "subpoint")), ("point", r"пункт\w?", ("subpoint",)), ("subpoint", r"подпункт\w?", ())):
            if m := re.search(rf"(?<!\w){word}\s+({NUMBER})", low):
                for k in inner:
                    setattr(out, k, None)
                setattr(out, name, m.group(1))
        if m := re.search(r"(?<!\w)абзац\w*\s+(\w+(?:\s+\w+)?)", low):
            out.paragraph = ordinal_value(m.group(1))
        return out


def read_instruction(item: str, context: Address = Address()) -> dict | None:
    text = re.sub(r"\s+", " ", item.translate(QUOTES)).strip().rstrip(";")
    bare = re.sub(r'"[^"]*"', '""', text).lower()
    quoted = re.findall(r'"([^"]*)"', text)
    for operation, phrase in PHRASES:
        m = phrase.search(bare if operation != "insert_unit" else text.lower())
        if not m:
            continue
        need = {"repeal": 0, "delete_paragraph": 0, "replace_words": 2}.get(operation, 1)
        if len(quoted) < need:
            continue
        old = quoted[0].strip() if operation in ("replace_words", "delete_words") or (operation == "insert_words" and "после слов" in bare and len(quoted) > 1) else None
        new = quoted[-1].strip() if operation not in ("repeal", "delete_paragraph", "delete_words") else None
        kind = number = None
        if operation == "insert_unit":
            kind, number = NEW_KINDS.get(m.group("kind"), "article"), m.group("number")
        return {"operation": operation, **asdict(context.refine(text.split('"')[0])), "old": old, "new": new, "new_kind": kind, "new_number": number, "raw": text}
    return None


def read_law(text: str) -> list[dict]:
    """Instructions of a law in order; the closing article on its entry into force is left out."""
    body = text.translate(QUOTES)
    if m := re.search(r"следующ\w+\s+изменени\w+:", body, re.I):
        body = body[m.end() :]
    if m := re.search(r"^\s*Статья \d+\.?\s+(?:1\.\s*)?Настоящий Федеральный закон", body, re.M):
        body = body[: m.start()]
    out = []
    for item in re.split(r"^\s*\d+\)\s+", body, flags=re.M)[1:]:
        head, *subs = re.split(r"^\s*[а-я]\)\s+", item.strip(), flags=re.M)
        context = Address().refine(head) if subs and re.match(r"в\s+(?:стать|пункт|подпункт)", head, re.I) else None
        for part in subs if context else [item]:
            if found := read_instruction(part, context or Address()):
                out.append(found)
    return out


def instructions(laws: DataFrame) -> DataFrame:
    """One row per instruction of laws(act, law, text)."""
    names = [f.split()[0] for f in INSTRUCTIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"act": a, "law": n, "nth": i} | r for a, n, t in zip(*(b.column(c).to_pylist() for c in ("act", "law", "text"))) for i, r in enumerate(read_law(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int32() if n in ("nth", "paragraph") else pa.string()) for n in names], names=names)

    return laws.select("act", "law", "text").repartition("act", "law").mapInArrow(run, INSTRUCTIONS)


class Failed(Exception):
    pass


@dataclass
class Act:
    """Units of one act by identifier, changed in place by instructions."""

    act: str
    texts: dict[str, str]
    repealed: set[str] = field(default_factory=set)
    articles: dict[str, str] = field(default_factory=dict)  # the first path of every article
    inside: dict[str, list[str]] = field(default_factory=dict)  # units of an article's path

    def __post_init__(self) -> None:
        for unit in self.texts:
            self.listed(unit)

    def listed(self, unit: str) -> None:
        m = re.match(ARTICLE, unit[len(self.act) :]) if unit.startswith(self.act) else None
        if m:
            path = self.act + m.group()
            self.inside.setdefault(path, []).append(unit)
            if path == unit:
                self.articles.setdefault(m.group(1), unit)

    def below(self, unit: str) -> list[str]:
        """A unit of an article and those below it."""
        path = self.act + re.match(ARTICLE, unit[len(self.act) :]).group()
        return [u for u in self.inside[path] if u == unit or u.startswith(unit + ".")]

    def unit(self, i: dict, *, inside: str | None = None) -> str:
        path = self.articles.get((i["article"] or "").replace(".", "-"))
        if not path:
            raise Failed(f"article {i['article']} not found")
        for key, mark in (("point", ".p"), ("subpoint", ".sp")):
            if i[key] and inside != key:
                path += mark + i[key].replace(".", "-")
        if path not in self.texts:
            raise Failed(f"unit {path} not found")
        return path

    def apply(self, i: dict) -> tuple[str, str, str]:
        """(unit, text before, text after) of an instruction, or Failed."""
        if i["operation"] == "insert_unit":
            if i["new_kind"] == "article":
                host = self.unit({**i, "point": None, "subpoint": None})
                unit = f"{host.rsplit('.art', 1)[0]}.art{i['new_number'].replace('.', '-')}"
            else:
                host = self.unit({**i, "subpoint": None} if i["new_kind"] == "subpoint" else {**i, "point": None, "subpoint": None})
                unit = host + (".sp" if i["new_kind"] == "subpoint" else ".p") + i["new_number"].replace(".", "-")
            if unit in self.texts:
                raise Failed("unit exists already")
            self.texts[unit] = i["new"]
            self.listed(unit)
            return unit, "", i["new"]
        unit = self.unit(i)
        before = self.texts[unit]
        parts = [p for p in before.split("\n\n") if p.strip()]
        k = i["paragraph"]
        if k and k > len(parts) or (i["operation"] == "delete_paragraph" and not k):
            raise Failed(f"no paragraph {k}")
        if i["operation"] == "repeal":
            self.repealed.update(self.below(unit))
            after = ""
        elif i["operation"] == "replace":
            after = "\n\n".join([*parts[: k - 1], i["new"], *parts[k:]] if k else [i["new"]])
        elif i["operation"] == "insert_paragraph":
            after = "\n\n".join([*parts, i["new"]])
        elif i["operation"] == "delete_paragraph":
            after = "\n\n".join(parts[: k - 1] + parts[k:])
        else:
            where = parts[k - 1] if k else "\n\n".join(parts)
            changed = self.words(where, i)
            after = "\n\n".join([*parts[: k - 1], changed, *parts[k:]]) if k else changed
        self.texts[unit] = after
        return unit, before, after

    @staticmethod
    def words(text: str, i: dict) -> str:
        if i["old"] is None:  # at the end, before a closing mark
            return re.sub(r"\s*([.;]?)\s*$", lambda m: f" {i['new']}{m.group(1)}", text, count=1)
        if (n := text.count(i["old"])) != 1:
            raise Failed(f"words found {n} times, once is needed")
        if i["operation"] == "delete_words":
            return re.sub(r"\s*" + re.escape(i["old"]), "", text, count=1)
        return text.replace(i["old"], i["new"] if i["operation"] == "replace_words" else f"{i['old']} {i['new']}")


def apply_all(act: str, texts: dict[str, str], rows: list[dict]) -> tuple[Act, list[dict]]:
    state, out = Act(act, dict(texts)), []
    for i in rows:
        result = {"act": act, "law": i["law"], "nth": i["nth"], "operation": i["operation"], "status": "ok", "unit_id": None, "reason": None, "old_text": None, "new_text": None, "diff": None}
        try:
            unit, before, after = state.apply(i)
            diff = "\n".join(difflib.unified_diff(before.splitlines(), after.splitlines(), "before", "after", lineterm="", n=1))
            result |= {"unit_id": unit, "old_text": before, "new_text": after, "diff": diff}
        except Failed as why:
            result |= {"status": "failed", "reason": str(why)}
        out.append(result)
    return state, out


def _part(act, article, linked):
    """The group of an article: one of ``PARTS``, or the act's one of articles that insertions link."""
    return F.when(linked, F.lit(-1)).otherwise(F.pmod(F.hash(act, F.coalesce(article, F.lit(""))), F.lit(PARTS)))


def apply_laws(units: DataFrame, laws: DataFrame) -> DataFrame:
    """Outcome of every instruction of laws on units(act, unit_id, text)."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = right.sort_values(["law", "nth"]).astype(object).where(lambda x: x.notna(), None).to_dict("records")
        for r in rows:
            r["paragraph"] = int(r["paragraph"]) if r["paragraph"] is not None else None
        _, out = apply_all(key[0], dict(zip(left["unit_id"], left["text"])), rows)
        return pd.DataFrame(out, columns=[f.split()[0] for f in RESULTS.split(", ")])

    told = written(instructions(laws)).withColumn("__article", F.replace("article", F.lit("."), F.lit("-")))
    new = told.where("operation = 'insert_unit' and new_kind = 'article'")
    linked = new.select("act", F.explode(F.array("__article", F.replace("new_number", F.lit("."), F.lit("-")))).alias("__article")).where("__article is not null").distinct().withColumn("__linked", F.lit(True))
    dealt = lambda d: d.join(linked.hint("merge"), ["act", "__article"], "left").withColumn("__part", _part(F.col("act"), F.col("__article"), F.col("__linked"))).drop("__article", "__linked")
    live = units.where("duplicate_of is null and kind <> 'paragraph'").select("act", "unit_id", "text")
    path = F.when(F.col("unit_id").startswith(F.col("act")), F.substring("unit_id", F.length("act") + 1, F.length("unit_id")))
    placed = live.withColumn("__article", F.nullif(F.regexp_extract(path, "(?U)" + ARTICLE, 1), F.lit(""))).where("__article is not null")  # no instruction reaches the others
    return dealt(placed).groupBy("act", "__part").cogroup(dealt(told).groupBy("act", "__part")).applyInPandas(run, RESULTS)


def patched(units: DataFrame, results: DataFrame) -> DataFrame:
    """unit_id, text, repealed after all instructions that succeeded: the last outcome of each unit, inserted ones too.

    A repealed unit takes its descendants with it.
    """
    last = results.where("status = 'ok'").groupBy("unit_id").agg(F.max_by(F.struct("new_text", "operation"), F.struct("law", "nth")).alias("__r"))
    gone = last.where("__r.operation = 'repeal'").select(F.col("unit_id").alias("__gone"))
    base = units.where("duplicate_of is null and kind <> 'paragraph'").select("unit_id", "text").join(last, "unit_id", "full_outer")
    out = base.select("unit_id", F.coalesce("__r.new_text", "text").alias("text"))
    from lexgrove.functions.hierarchy import ancestors

    lost = out.select("unit_id", F.explode(ancestors("unit_id")).alias("__gone")).join(gone, "__gone").select("unit_id", F.lit(True).alias("__lost")).distinct()
    return out.join(lost, "unit_id", "left").select("unit_id", "text", F.coalesce("__lost", F.lit(False)).alias("repealed"))


def round_trip(expected: DataFrame, current: DataFrame) -> DataFrame:
    """Mismatches of patched(..) and a current text table: expected_repealed, missing, text_differs, unexpected."""
    a = expected.select("unit_id", F.col("text").alias("__want"), "repealed")
    b = current.select("unit_id", F.col("text").alias("__have"), F.lit(True).alias("__in"))
    kind = F.when(F.col("repealed") & F.col("__in") & (F.trim("__have") != ""), "expected_repealed").when(~F.col("repealed") & F.col("__in").isNull(), "missing").when(F.col("repealed").isNull(), "unexpected").when(~F.col("repealed") & (F.col("__want") != F.col("__have")), "text_differs")
    return a.join(b, "unit_id", "full_outer").select("unit_id", kind.alias("kind")).where("kind is not null")


def law_effective_date(text, published):
    """struct(day, reason): when a law takes effect by its closing words; NULL asks for a person."""
    low = F.lower(F.translate(text, "«»„“”", '"""""'))
    at = F.length(low) - F.position(F.reverse(F.lit("вступает в силу")), F.reverse(low)) - F.lit(len("вступает в силу") - 2)
    tail = F.when(low.contains("вступает в силу"), F.substring(low, F.greatest(at - 200, F.lit(1)), F.lit(1000)))
    days = F.regexp_extract(tail, r"по истечении (\d+) дней со дня", 1)
    pick = lambda d, why: F.struct(d.cast("date").alias("day"), F.lit(why).alias("reason"))
    none = F.lit(None).cast("date")
    return (
        F.when(tail.isNull(), pick(none, "no wording")).when(tail.contains("не ранее 1-го числа очередного налогового периода"), pick(none, "depends on the tax period"))
        .when(word_date(tail, r"вступает в силу с ").isNotNull(), pick(word_date(tail, r"вступает в силу с "), "by the text"))
        .when(tail.contains("по истечении одного месяца со дня") & published.isNotNull(), pick(F.add_months(published, 1), "a month after publication"))
        .when(tail.contains("по истечении десяти дней со дня") & published.isNotNull(), pick(F.date_add(published, 10), "ten days after publication"))
        .when((days != "") & published.isNotNull(), pick(F.date_add(published, F.nullif(days, F.lit("")).cast("int")), "days after publication"))
        .when(tail.contains("вступает в силу со дня") & published.isNotNull(), pick(published, "on publication")).otherwise(pick(none, "wording not recognised"))
    )
