"""Stems and stop words of Russian as column expressions, by the published suffix-stripping rules.

A word's endings are looked for after its first vowel (RV); derivational endings after the second change from a vowel
to a consonant (R2). Ending classes are tried in their order, the longest ending of a class first, so every rule is one
anchored pattern and the whole stays inside the JVM. Words of other letters are their own stems.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels and the ending classes of the published rules. Those of a _LED class stand after а or я only.
VOWELS = "аеиоуыэюя"
GERUND_LED, GERUND = "в вши вшись", "ив ивши ившись ыв ывши ывшись"
REFLEXIVE = "ся сь"
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE_LED, PARTICIPLE = "ем нн вш ющ щ", "ивш ывш ующ"
VERB_LED = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
DERIVATIONAL, SUPERLATIVE = "ост ость", "ейш ейше"
# Words that no search asks for.
STOP_WORDS = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из
ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей
может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот
того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при
наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо
свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
""".split()


def alternatives(endings: str) -> str:
    return "|".join(sorted(endings.split(), key=len, reverse=True))


def ending(free: str, led: str = "") -> str:
    """A pattern for the longest ending of a class; group 1 is the letter that a led ending has to follow."""
    return f"(?:([ая])(?:{alternatives(led)})|(?:{alternatives(free)}))$" if led else f"()(?:{alternatives(free)})$"


GERUNDS, PARTICIPLES, VERBS = ending(GERUND, GERUND_LED), ending(PARTICIPLE, PARTICIPLE_LED), ending(VERB, VERB_LED)
HEAD = f"^[^{VOWELS}]*[{VOWELS}]"
DERIVED = f"^([^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}].*)(?:{alternatives(DERIVATIONAL)})$"


def _cut(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "$1")


def stem(word: Column) -> Column:
    """The stem of one lower-case word; ё counts as е."""
    w = F.translate(word, "ё", "е")
    head = F.regexp_extract(w, HEAD, 0)
    one = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is computed once

    def bent(rv: Column) -> Column:
        """RV without gerund ending, else without reflexive and then adjectival, verbal or noun ending."""
        plain = one(_cut(rv, ending(REFLEXIVE)), lambda x: F.when(x.rlike(ending(ADJECTIVE)), _cut(_cut(x, ending(ADJECTIVE)), PARTICIPLES)).when(x.rlike(VERBS), _cut(x, VERBS)).otherwise(_cut(x, ending(NOUN))))
        return F.when(rv.rlike(GERUNDS), _cut(rv, GERUNDS)).otherwise(plain)

    def bare(rv: Column) -> Column:
        """Last of all: superlative and doubled н, or a soft sign."""
        short = _cut(rv, ending(SUPERLATIVE))
        return F.when(short.rlike("нн$"), F.regexp_replace(short, "н$", "")).when(short != rv, short).otherwise(F.regexp_replace(rv, "ь$", ""))

    rv = F.regexp_replace(bent(F.substring(w, F.length(head) + 1, F.length(w))), "и$", "")
    whole = _cut(F.concat(head, rv), DERIVED)
    done = one(whole, lambda x: F.concat(head, bare(F.substring(x, F.length(head) + 1, F.length(x)))))
    return F.when(w.rlike("^[а-я]+$") & (head != ""), done).otherwise(w)


def words(text: str | Column) -> Column:
    """Lower-case letter and digit runs of a text, ё as е."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.lower(c), "ё", "е"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def kept(words_: Column) -> Column:
    """Words without stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words_, lambda w: ~F.array_contains(stop, w))


def terms(text: str | Column) -> Column:
    """Stems of a text's words in order, stop words gone: what a stemmed index holds."""
    return F.transform(kept(words(text)), stem)


def positions(text: str | Column) -> Column:
    """array of struct(term, at): stems with the place of their word, stop words counted but not listed."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    placed = F.transform(words(text), lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    return F.transform(F.filter(placed, lambda p: ~F.array_contains(stop, p["word"])), lambda p: F.struct(stem(p["word"]).alias("term"), p["at"].alias("at")))
