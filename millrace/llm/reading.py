"""Reading level of a document's own prose.

Classic formulas from sentence length, word length and syllables estimate a grade each; their median
is the document's grade, in the language of its own prose. Levels are cut from grades where a sample of
rated documents says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import saved, spread

LANGUAGES = ["en", "de", "es", "fr", "it", "pt", "nl"]
#: Languages with syllable rules and formulas of their own; the others are graded by LIX and RIX, which ask for no syllables.
OWN_FORMULAS = ["en", "de", "es"]
#: The commonest function words of each language, by which a passage's language shows (fixed values).
FUNCTION_WORDS = {
    "en": "the a an and or but if of in on at to for with from by is are was were be been it its this that these those each every one when while so because as after before not no than then there which who what how has have had will can may all any some into over under about between",
    "de": "der die das den dem des ein eine einen einem einer und oder aber wenn von in im am an auf zu zur zum für mit aus bei ist sind war waren nicht kein es sich dass als auch nur so noch nach vor über unter wie wird werden hat haben jede jeder jedes dieser diese dieses",
    "es": "el la los las un una unos unas y o pero si de del en al a por para con sin sobre es son era no ni que como cuando donde porque se su sus lo le ya muy más este esta estos estas cada hasta desde entre",
    "fr": "le la les un une des et ou mais si de du en au aux pour avec sans sur dans par est sont était ne pas que qui comme quand où parce se sa son ses ce cette ces plus très après avant chaque",
    "it": "il lo la gli le un uno una e o ma se di del della dei in nel nella per con senza su da è sono era non che come quando dove perché si suo sua questo questa ogni più molto dopo prima",
    "pt": "o a os as um uma e ou mas se de do da dos das em no na nos nas por para com sem sobre é são era não que como quando onde porque seu sua este esta cada mais muito após antes",
    "nl": "de het een en of maar als van in op aan te voor met uit bij is zijn was waren niet geen dat die dit deze er ook nog na over onder tussen hoe wordt worden heeft hebben elke ieder",
}
#: Fewest words between white space for a document to get a level.
LEAST_WORDS = 60
#: Most rated documents that the cuts are fitted on; beyond it a seeded sample of as many.
MOST_RATED = 50_000
#: Cuts between levels where no ratings are given: a school grade apart as in the usual bands.
USUAL_CUTS = [5.0, 8.0, 11.0, 15.0]

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_SKIP = re.compile(r"^\s{0,3}(?:#{1,6}(?:\s|$)|>|\||(?:[-*_]\s*){3,}$|={3,}\s*$|\[[^\]]+\]:\s)")
_BLOCK = re.compile(r"<(pre|code|table|script|style|h[1-6])\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+(?:\[[ xX]\]\s+)?")
_LINK = re.compile(r"!?\[[^\]]*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)|<?(?:https?://|www\.)\S+>?")
_TICKS = re.compile(r"`[^`\n]*`")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"[.!?…][\"'”’)\]*_]*$")
_OPENS = re.compile(r"^[\"'“‘(\[¿¡*_]*[A-ZÀ-ÖØ-Þ0-9]")


def passages(text: str) -> list[str]:
    """Prose of a text: paragraphs and list items, without headings, summary lines, tables, code and links."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", text))
    out: list[str] = []
    held: list[str] = []
    fence, blank = "", True

    def end() -> None:
        if held:
            out.append(" ".join(held))
            held.clear()

    for line in text.split("\n"):
        if fence:
            if line.lstrip().startswith(fence):
                fence = ""
            continue
        bare = line.strip()
        if not bare:
            end()
            blank = True
            continue
        first = bare[0]
        if first in "`~" and (m := _FENCE.match(line)):
            end()
            fence = m[1][:3]
            continue
        if first in "#>|-*_=[" and _SKIP.match(line):
            if first == "=" or (first == "-" and not blank):  # underlines what is then a heading
                held.clear()
            end()
            blank = True
            continue
        if blank and not held and (line.startswith("    ") or line.startswith("\t")):
            continue  # indented code
        if (first in "-*+•" or first.isdigit()) and (m := _ITEM.match(line)):
            end()
            bare = line[m.end() :].strip()
        blank = False
        if bare.count("|") > 1:
            end()
            continue
        if "`" in bare:
            bare = _TICKS.sub(" ", bare)
        if "](" in bare or "://" in bare or "www." in bare:
            bare = _LINK.sub(" ", bare).strip()
        if bare:
            held.append(bare)
    end()
    return out


# One syllable's vowels. German: what is spoken as one. Spanish: a strong vowel with the weak ones beside it.
_GERMAN = re.compile(r"aa|ee|oo|ie(?!ll)|ei|ai|au|eu(?!m$|s$)|äu|ey|ay|oy|[aeiouyäöü]")
_SPANISH = re.compile(r"[iuü]?[aeoáéó](?:[iuü](?![aeoáéóíú])|y$)?|[iuü]?[íú]|[iuü]+y?$|[iuü]+|y$")
_ENGLISH = re.compile(r"[aeiouy]+")
# German prefixes before a vowel of their own, and the u of qu, that is none.
_BE_GE = re.compile(r"^(be|ge)(?=e(?:nd|rb|rd|hr|ig|il|in|ng))")
_QU = re.compile(r"qu")
# English: vowels side by side that are two syllables, written from the sound's rule to its exceptions.
_APART = re.compile(
    r"ia(?!ge|nce$|n$|ns$|l$|lly$|ls$)|(?<![cstgx])ia(?=n|l)|(?<![cstg])(?<!ll)io(?!u)|[^cstgx]iou|iu|eo(?!u|ple|n$|ns$|nd)|[^gq]ua(?=[lt])|[^gq]uo(?!y)|(?<=cr)ea(?=t(?!ur))|(?<=r)ea(?=li|ct|pp|ss|rr)|(?<=id)ea|(?<=ar)ea|(?<=th)ea(?=t)|oe(?=t|m)"
    r"|(?<=[lrdqvp])ie(?=t|n[ct])|(?<=c)ie(?=ty)|ei(?=ty)|(?<=sc)ie|ie(?=r$|st$)|[aeouy]i(?=ng)|yi|[fdr]ue(?=l)|uou|(?<=^c)oo(?=[pr]d|pe)|[aeiouy][^aeiouy]*(?<=s)m$"
)
_MUTE = re.compile(r"(?:[^aeiouytd]ed|[^aeiouylscxzgh]es|[^cs]hes|[gq]ue|[^aeiouyl]e|[aeiouy]le|[aeiouy][^aeiouyl]?les)$")
_SHORT = re.compile(r"[^aeiouy](?:les?|res?)$")
# A mute e inside a word, before an ending that begins with a consonant.
_INNER = re.compile(r"(?<=[aeiouy])[^aeiouyl]e(?=(?:ment|ments|ly|ful|less|ness|some)$)")


def syllables(word: str, lang: str) -> int:
    """Syllables of a word in English, German or Spanish, by rules of how it is hyphenated."""
    w = word.lower()
    if lang == "es":
        return max(1, len(_SPANISH.findall(_QU.sub("q", w.replace("gue", "ge").replace("gui", "gi")))))
    if lang == "de":
        split = len(_BE_GE.findall(w))
        return max(1, len(_GERMAN.findall(_BE_GE.sub("b", _QU.sub("q", w)))) + split)
    if lang != "en":
        raise ValueError(f"no syllable rules for {lang}")
    if len(w) <= 2:
        return 1
    w = _QU.sub("q", w)
    n = len(_ENGLISH.findall(w)) + len(_APART.findall(w)) - len(_INNER.findall(w))
    if _MUTE.search(w) and not _SHORT.search(w):
        n -= 1
    return max(1, n)


#: What is kept of a token: word, letters, syllables in en, de and es, whether it may end and begin a
#: sentence, then a mark for each language it is a function word of.
_MARKS = {w: [w in set(FUNCTION_WORDS[lang].split()) for lang in LANGUAGES] for lang in LANGUAGES for w in FUNCTION_WORDS[lang].split()}
_SYLLABLES = {"en": 2, "de": 3, "es": 4}
_END, _OPEN, _MARK = 5, 6, 7
_BREAK = [0] * _END + [1, 1] + [0] * len(LANGUAGES)


class _Tokens(dict):
    """Numbers tokens and keeps what the formulas need of each; number 0 is the end of a passage."""

    def __init__(self, most: int = 300_000):
        self.most, self.facts = most, [_BREAK]

    def __missing__(self, token: str) -> int:
        parts = _LETTERS.findall(token)
        low = [x.lower() for x in parts]
        self.facts.append(
            [
                int(bool(parts)), sum(map(len, parts)), *(sum(syllables(x, lang) for x in low) for lang in ("en", "de", "es")),
                int(bool(_ENDS.search(token))), int(bool(_OPENS.match(token))), *(_MARKS.get(low[0], _BREAK[_MARK:]) if len(low) == 1 else _BREAK[_MARK:]),
            ]
        )
        self[token] = n = len(self.facts) - 1
        return n

    def settle(self) -> np.ndarray:
        """The table of facts; forgets all if there are too many tokens."""
        t = np.array(self.facts, np.int32)
        if len(self.facts) > self.most:
            self.clear()
            self.facts = [_BREAK]
        return t


#: Counts of a document's own prose, and its language.
FEATURES = ["words", "sentences", "syllables", "letters", "poly", "long", "mono"]


def _grades(x: dict[str, np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Median of the grade estimates (published formulas; their coefficients are fixed values)."""
    w, s = np.maximum(x["words"], 1), np.maximum(x["sentences"], 1)
    per_s, syl, let = w / s, x["syllables"] / w, x["letters"] / w
    poly, long = 100 * x["poly"] / w, 100 * x["long"] / w
    ari = 4.71 * let + 0.5 * per_s - 21.43
    lix = (per_s + long - 8) / 4
    rix = np.interp(x["long"] / s, [0, 0.2, 0.5, 0.8, 1.3, 1.8, 2.4, 3.0, 3.7, 4.5, 5.3, 6.2, 7.2, 27.2], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 32])
    # SMOG is left out: it is defined for thirty sentences and more, which most documents don't have.
    en = [0.39 * per_s + 11.8 * syl - 15.59, 0.4 * (per_s + poly), ari, 0.0588 * 100 * let - 0.296 * 100 / per_s - 15.8, lix]
    amstad = 180 - per_s - 58.5 * syl
    second = 0.2007 * poly + 0.1682 * per_s + 0.1373 * long - 2.779
    de = [second, 0.2963 * poly + 0.1905 * per_s - 1.1144, 0.2744 * poly + 0.2656 * per_s - 1.693, (100 - amstad) / 6, lix]
    huerta = 206.84 - 60 * syl - 1.02 * per_s
    es = [(100 - huerta) / 6, 0.4 * (per_s + poly), lix]
    of = {"en": en, "de": de, "es": es}
    return np.select([lang == k for k in of], [np.median(np.stack(v), axis=0) for v in of.values()], (lix + rix) / 2)


def _measure(doc: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for b in batches:
            docs, sizes, flat, own = [], [], [], []
            for k, t in enumerate(b.column(text).to_pylist()):
                if not t or len(t) < 2 * LEAST_WORDS - 1:
                    continue
                if not t.isascii():
                    t = _INVISIBLE.sub("", t)
                before, told = len(flat), len(sizes)
                for p in passages(t):
                    n = [known[w] for w in p.split()]
                    n.append(0)
                    flat += n
                    sizes.append(len(n))
                if len(flat) - before - (len(sizes) - told) < LEAST_WORDS and len(t.split()) < LEAST_WORDS:
                    del flat[before:], sizes[told:]
                    continue
                own += [len(docs)] * (len(sizes) - told)
                docs.append(k)
            facts = known.settle()
            if docs:
                yield _described(b.column(doc).take(pa.array(docs, pa.int64())), np.array(flat, np.int64), np.array(sizes, np.int64), np.array(own, np.int64), len(docs), facts)

    return run


def _described(ids: pa.Array, flat: np.ndarray, sizes: np.ndarray, own: np.ndarray, n: int, facts: np.ndarray) -> pa.RecordBatch:
    """Language, features and grade of the documents of a batch, all at once."""
    sums = {f: np.zeros(n) for f in FEATURES}
    names = np.array(["en"] * n)
    if len(flat):
        total = lambda v, at, m: np.bincount(at, weights=v, minlength=m)
        passage = np.repeat(np.arange(len(sizes)), sizes)
        is_word = facts[flat, 0].astype(bool)
        # A sentence ends with a token that may end one before a token that may begin one.
        ends = (facts[flat, _END] & np.append(facts[flat[1:], _OPEN], 1)).astype(bool) | (flat == 0) | np.append(flat[1:] == 0, True) & (facts[flat, _END] > 0)
        sentence = np.cumsum(np.append(False, ends[:-1]))
        filled = total(is_word, sentence, int(sentence[-1]) + 1) > 0
        first = np.flatnonzero(np.append(True, np.diff(sentence) > 0))
        # Language of each passage by its function words, of each document by its passages' words.
        votes = np.stack([total(facts[flat, _MARK + i], passage, len(sizes)) for i in range(len(LANGUAGES))])
        length = total(is_word, passage, len(sizes))
        voted = np.where(votes.max(axis=0) > 0, votes.argmax(axis=0), -1)
        lang = np.stack([total(length * (voted == i), own, n) for i in range(len(LANGUAGES))]).argmax(axis=0)
        ours = (voted == lang[own]) | (voted < 0)
        whose = own[passage[first]]
        sums["sentences"] = total(filled & ours[passage[first]], whose, n)
        kept = is_word & ours[passage]
        w, d = flat[kept], own[passage[kept]]
        syl, let = facts[w, np.array([_SYLLABLES.get(x, 2) for x in LANGUAGES])[lang][d]], facts[w, 1]
        for f, v in (("words", np.ones(len(w))), ("syllables", syl), ("letters", let), ("poly", syl >= 3), ("long", let > 6), ("mono", syl == 1)):
            sums[f] = total(v, d, n)
        names = np.array(LANGUAGES)[lang]
    grade = np.where(sums["words"] > 0, _grades(sums, names), 0.0)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(names.tolist()), *(pa.array(sums[f].astype(np.int64)) for f in FEATURES), pa.array(grade)], names=["doc", "lang", *FEATURES, "grade"]
    )


def reading_grades(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, lang, words, sentences, ..., grade`` of every document with LEAST_WORDS words or more.

    ``lang`` is the language most of the document's prose is in; passages in others don't count.
    """
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    docs = spread(docs)
    counts = ", ".join(f"{f} long" for f in FEATURES)
    return docs.mapInArrow(_measure("doc", "text"), f"doc {dict(docs.dtypes)['doc']}, lang string, {counts}, grade double")


#: How many ratings of its own a language needs to outweigh the shares of levels that the best-rated language has.
SHARE_WEIGHT = 30.0
#: Points at which the distribution of each language's grades is known.
KNOTS = 400


def fit_cuts(grade: np.ndarray, level: np.ndarray, levels: int, knots: np.ndarray | None = None, shares: np.ndarray | None = None) -> np.ndarray:
    """Cuts between successive levels with the fewest rated documents on the wrong side; never falling.

    With ``shares``, the part of all documents below each cut that is expected, a cut off it counts as
    SHARE_WEIGHT ratings times the part of documents between. Of cuts equally good to one rating
    the one where documents (``knots``, equal parts of them between) are sparsest is taken, without
    knots the middle one. Without shares a level that no rating reaches, at either end, is never given.
    """
    order = np.argsort(grade, kind="stable")
    g, v, out = grade[order], level[order], []
    at = np.concatenate([[-np.inf], (g[:-1] + g[1:]) / 2, [np.inf]])
    if knots is not None and len(knots) > 1:
        at = np.union1d(at, (knots[:-1] + knots[1:]) / 2)
        spread = np.interp(at, (knots[:-1] + knots[1:]) / 2, np.convolve(np.pad(np.diff(knots), 1, mode="edge"), [0.5, 1.0, 0.5], "valid"))
        below = np.searchsorted(knots, at) / len(knots)
    rated_below = np.searchsorted(g, at)
    for k in range(1, levels):
        above = v > k
        wrong = np.concatenate([[0], np.cumsum(above)])[rated_below] + (~above).sum() - np.concatenate([[0], np.cumsum(~above)])[rated_below]
        if knots is None or len(knots) < 2:
            best = np.flatnonzero(wrong == wrong.min())
            out.append(at[best[len(best) // 2]])
            continue
        cost = wrong + (SHARE_WEIGHT * np.abs(below - shares[k - 1]) if shares is not None else 0.0)
        best = np.flatnonzero(cost <= cost.min() + 1)
        if shares is None and (above.all() or not above.any()):
            out.append(-np.inf if above.all() else np.inf)
        else:
            out.append(at[best[np.where(np.isfinite(at[best]), spread[best], -1).argmax()]])
    return np.maximum.accumulate(np.array(out))


def _scales(lang: np.ndarray, grade: np.ndarray, level: np.ndarray, levels: int, knots: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Cuts of each language: by its own ratings, and by the shares of levels in the best-rated language, the more the fewer it has."""
    if not len(grade):
        return {x: np.array(USUAL_CUTS[: levels - 1]) for x in LANGUAGES}
    names, counts = np.unique(lang, return_counts=True)
    main = names[counts.argmax()]
    cuts = {main: fit_cuts(grade[lang == main], level[lang == main], levels, knots[main])}
    shares = np.searchsorted(knots[main], cuts[main]) / len(knots[main])
    for x in LANGUAGES:
        if x != main:
            cuts[x] = fit_cuts(grade[lang == x], level[lang == x], levels, knots[x], shares) if x in knots else cuts[main]
    return cuts


def reading_levels(
    documents: DataFrame, doc_id: str, text: str, ratings: DataFrame, rated_doc: str, level: str, levels: int = 5, most_rated: int = MOST_RATED
) -> DataFrame:
    """``doc, lang, words, sentences, ..., grade, level`` for every document of LEAST_WORDS words or more.

    ``level`` runs from 1, the easiest, to ``levels``. Cuts are fitted on at most ``most_rated`` rated
    documents, taken by hash where there are more, and on the distribution of all documents' grades in
    each language; a document's rating is the median of its raters. Languages without formulas of
    their own are graded by LIX and RIX.
    Everything else reads every document whole.

    Defined cases: null and empty texts, and texts of fewer words between white space, get no row; a
    text without prose of its own has grade 0; null ratings, ratings outside 1 to ``levels`` and
    ratings of unknown documents don't count; without ratings the usual grade bands cut; repeated
    documents get a row each; empty tables give no rows. Ties go to the lower level. Only the named
    columns are read, so others can't clash.
    """
    grades = saved(reading_grades(documents, doc_id, text), "grades")
    rated = ratings.select(F.col(rated_doc).alias("doc"), F.col(level).cast("double").alias("v")).where(f"doc is not null and v between 1 and {levels}")
    rated = rated.groupBy("doc").agg(F.percentile("v", 0.5).alias("v")).orderBy(F.xxhash64("doc"), "doc").limit(most_rated)
    # A document that stands repeatedly is rated once, by its first grade.
    once = grades.where("words > 0").join(F.broadcast(rated), "doc").groupBy("doc", "v").agg(F.min(F.struct("lang", "grade")).alias("g"))
    known = once.select("g.lang", "g.grade", "v").toPandas()
    parts = grades.where("words > 0").groupBy("lang").agg(F.percentile_approx("grade", [i / KNOTS for i in range(KNOTS + 1)], 10_000).alias("q")).collect()
    cuts = _scales(known["lang"].to_numpy(str), known["grade"].to_numpy(float), known["v"].to_numpy(float), levels, {r["lang"]: np.array(r["q"]) for r in parts})
    steps = F.create_map(*[x for lang in LANGUAGES for x in (F.lit(lang), F.array(*[F.lit(float(c)) for c in cuts[lang]]))])
    reached = F.size(F.filter(steps[F.col("lang")], lambda c: F.col("grade") > c))
    return grades.select("*", (reached + 1).cast("long").alias("level"))
