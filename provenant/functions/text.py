"""Text scalars: normalisation, signature and negation scoring, mode rules, query leak filters.

Everything here is a Column expression, so it stays in the JVM; only the NFKD
normalisation needs Python (Arrow batches), as Spark has no such function.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from provenant.functions import vectors as V

# Patterns, aliases and word lists that decide what counts as a hit.
NEGATIONS = (
    r"\bnot\s+(?:visible|present|legible|readable|found|shown|seen|there)\b",
    r"\bno\s+(?:clearly\s+)?(?:visible\s+)?(?:text|mark|label|signature|code|acronym)\b",
    r"\bthere\s+is\s+no\b",
    r"\bnone\s+(?:of\s+the\s+)?(?:provided\s+)?(?:images?|panels?)\s+(?:show|contain|include|has|have)\b",
    r"\bnone\s+(?:contain|contains|show|shows|include|includes)\b",
    r"\bnor\s+(?:is|are|does|do)\s+(?:there\s+)?(?:any\s+)?(?:visible\s+)?(?:text|mark|label|signature|code|acronym)?\b",
    r"\bdoes\s+not\s+(?:contain|show|include|appear)\b",
    r"\bdo\s+not\s+(?:see|read|find|detect)\b",
    r"\bcannot\s+(?:see|read|find|detect|confirm|identify|make\s+out)\b",
    r"\bcannot\s+be\s+(?:determined|confirmed|identified|read|seen|found)\b",
    r"\bcant\s+(?:see|read|find|detect|confirm|identify|make\s+out)\b",
    r"\bcan\s+not\s+(?:see|read|find|detect|confirm|identify|make\s+out)\b",
    r"\bnot\s+able\s+to\s+(?:see|read|find|detect|confirm|identify|make\s+out)\b",
    r"\bnot\s+match\s+any\b",
    r"\bdoes\s+not\s+match\s+any\b",
    r"\bnot\s+(?:an\s+)?exact\s+match\b",
)
#: SIG stands for the quoted signature.
LOCAL_NEGATIONS = (
    r"\bSIG\b\s+(?:is|was|appears|seems)?\s*not\b",
    r"\bSIG\b\s+(?:cannot|cant|can\s+not)\s+(?:be\s+)?(?:seen|read|found|detected|confirmed|identified|made\s+out)\b",
    r"\bSIG\b\s+(?:is|was|appears|seems)?\s*(?:not\s+)?(?:visible|present|legible|readable)\s+in\s+the\s+(?:provided\s+)?image\b",
    r"\bSIG\b\s+(?:is|was|appears|seems)?\s*(?:not\s+)?(?:visible|present|legible|readable)\s+in\s+(?:any|none)\b",
    r"\b(?:no|none)\b.*\b(?:exact\s+)?(?:text|mark|label|signature|code|acronym)?\s*\bSIG\b",
    r"\b(?:no|none)\b.*\b(?:contain|contains|show|shows|include|includes)\b.*\bSIG\b",
    r"\bnot\s+(?:an\s+)?exact\s+match\s+(?:to|for)\s+\bSIG\b",
    r"\bnot\s+(?:the\s+)?\bSIG\b",
)
AFFIRMATIONS = (
    r"\b(?:exact\s+)?(?:text|label|mark|signature|code|acronym|transcription)\b.*\b(?:is|says|reads|appears|visible|shown|written|printed)\b.*\bSIG\b",
    r"\b(?:can|could)\s+(?:clearly\s+)?(?:read|see|identify|transcribe)\s+\bSIG\b",
    r"\b(?:read|transcribe|identify)\s+\bSIG\b",
    r"\b(?:is|says|reads|appears|visible|shown|written|printed)\b\s+(?:as\s+)?[\"']?\bSIG\b",
    r"\bSIG\b\s+(?:is\s+)?(?:visible|shown|written|printed|readable|present)\b",
    r"\bvisible\s+(?:near|in|on).*?\bis\s+[\"']?\bSIG\b",
)
HEDGES = r"\b(?:not|none|cannot|cant|closest)\b"
COARSE_NEGATIONS = ("not visible", "no visible", "no object", "no such object", "cannot see", "cant see", "do not see", "not present", "not shown")
COLOR_ALIASES = {
    "black": ("black", "dark"), "blue": ("blue", "navy"), "green": ("green",), "orange": ("orange",), "pink": ("pink", "magenta", "fuchsia"),
    "red": ("red",), "teal": ("teal", "turquoise", "cyan"), "white": ("white", "pale"), "yellow": ("yellow", "gold", "golden"),
}
POSITION_ALIASES = {
    "upper left": ("upper left", "top left", "upper-left", "top-left"), "upper right": ("upper right", "top right", "upper-right", "top-right"),
    "lower left": ("lower left", "bottom left", "lower-left", "bottom-left"), "lower right": ("lower right", "bottom right", "lower-right", "bottom-right"),
    "center": ("center", "centre", "middle", "central"),
}
OBJECT_ALIASES = {
    "bottle": ("bottle", "water bottle", "plastic bottle"), "bottle cap": ("bottle cap", "cap", "lid"), "bowl": ("bowl", "small bowl", "dish"),
    "coffee cup": ("coffee cup", "cup", "mug"), "cup": ("cup", "mug"), "orange": ("orange", "ripe orange", "fruit"),
    "potted succulent": ("potted succulent", "succulent", "potted plant", "plant"), "spice jar": ("spice jar", "jar", "container"), "water bottle": ("water bottle", "bottle"),
}
OBJECT_STOPWORDS = ("a", "an", "and", "ball", "clean", "dark", "fresh", "large", "little", "new", "object", "ripe", "single", "small", "the", "tiny")
POSITION_PHRASES = ("center", "lower left", "lower right", "upper left", "upper right")
EXPERIMENT_TERMS = ("canary", "edited", "inserted", "left image", "original image", "right image", "watermark")
COLOR_WORDS = ("black", "blue", "green", "orange", "pink", "purple", "red", "teal", "white", "yellow")
OBJECT_HINTS = {
    "water bottle": "small bottle-like item", "bottle": "small bottle-like item", "coffee cup": "small cup-like item", "ceramic mug": "small cup-like item",
    "cup": "small cup-like item", "glass jar": "small container", "spice jar": "small container", "tin can": "small container", "bottle cap": "small cap-like item",
    "ripe apple": "small round fruit", "ripe orange": "small round fruit", "lemon": "small fruit", "banana": "small fruit", "small bowl": "small bowl-like item",
    "potted succulent": "small potted plant", "small flowerpot": "small potted plant", "small plush toy": "small soft toy", "figurine": "small decorative object",
    "matchbox": "small rectangular item", "notebook": "small rectangular item", "paperback book": "small rectangular item", "pen cup": "small desk item",
    "candle in glass jar": "small container",
}
# End of fixed values.

#: All but letters, digits, underscores and the blanks of Unicode; Java's own \\s is ASCII only.
_NOT_WORD = r"[^\p{L}\s\p{N}_\p{Z}\x1c-\x1f\x85]"
#: Ends of a word in any script.
BEGINS, ENDS = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def normalize(text: Column) -> Column:
    """Lower-case, drop everything but letters, digits, underscores and blanks, collapse blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _NOT_WORD, ""), r"[^\p{L}\p{N}_]+", " "))


@F.arrow_udf(StringType())
def nfkd(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def nfkd_each(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [unicodedata.normalize("NFKD", t) for t in x] for x in texts.to_pylist()], pa.list_(pa.string()))


def normalize_text(text: Column) -> Column:
    """:func:`normalize` after Unicode compatibility decomposition."""
    return normalize(nfkd(text))


def quoted(literal: Column) -> Column:
    """A literal for use inside a Java regular expression."""
    return F.concat(F.lit("\\Q"), literal, F.lit("\\E"))


def _with_signature(patterns: tuple[str, ...], signature: Column) -> Column:
    """One alternation of all patterns with the signature in place of SIG."""
    whole = "|".join(f"(?:{p})" for p in patterns)
    parts = whole.split("SIG")
    return F.concat(*[x for i, part in enumerate(parts) for x in ([quoted(signature)] if i else []) + [F.lit(part)]])


def sentence_is_negated(sentence: Column, signature: Column) -> Column:
    return sentence.rlike("|".join(f"(?:{p})" for p in NEGATIONS)) | F.regexp(sentence, _with_signature(LOCAL_NEGATIONS, signature))


def sentence_is_affirmative(sentence: Column, signature: Column) -> Column:
    alone = F.regexp(sentence, F.concat(F.lit(r"^(?:the\s+)?"), quoted(signature), F.lit("$")))
    first = F.regexp(sentence, F.concat(F.lit("^"), quoted(signature), F.lit(ENDS))) & ~sentence.rlike(HEDGES)
    return alone | first | F.regexp(sentence, _with_signature(AFFIRMATIONS, signature))


def as_word(literal: Column) -> Column:
    """A pattern for a literal that stands as a word."""
    return F.concat(F.lit(BEGINS), quoted(literal), F.lit(ENDS))


def contains_positive_signature(response: Column, signature: Column, norm=normalize_text) -> Column:
    """Whether the response holds the signature as a word, and some sentence of it affirms and does not negate it.

    Sentences are cut before they are normalised, so a word that only a cut
    sets free, as after a colon without a blank, is none of the whole response.
    """
    wanted = norm(signature)
    cut = F.split(response, r"[\n.!?;:]+")
    sentences = F.transform(cut if norm is normalize else nfkd_each(cut), normalize)
    # a lambda may not hold a Python function: the signature travels beside each sentence
    pairs = F.arrays_zip(sentences.alias("s"), F.array_repeat(wanted, F.size(sentences)).alias("w"))
    fits = lambda p: F.regexp(p["s"], as_word(p["w"])) & ~sentence_is_negated(p["s"], p["w"]) & sentence_is_affirmative(p["s"], p["w"])
    return F.coalesce((F.length(wanted) > 0) & F.regexp(norm(response), as_word(wanted)) & F.exists(pairs, fits), F.lit(False))


def response_is_negated(text: Column) -> Column:
    """``text`` is normalised already."""
    return text.rlike(r"\bnone\b|" + "|".join(COARSE_NEGATIONS))


def _lookup(table: dict[str, tuple[str, ...]], key: Column, otherwise: Column) -> Column:
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, key), otherwise)


def color_aliases(color: Column) -> Column:
    key = normalize_text(F.coalesce(color, F.lit("")))
    return _lookup(COLOR_ALIASES, key, F.array(key))


def position_aliases(position: Column) -> Column:
    key = normalize_text(F.coalesce(position, F.lit("")))
    return _lookup(POSITION_ALIASES, key, F.array(key))


def object_aliases(*candidates: Column) -> Column:
    """Ordered distinct aliases of the candidates: itself, its aliases, its longer words and theirs."""
    none = F.array().cast("array<string>")

    def of(candidate: Column) -> Column:
        whole = normalize_text(F.coalesce(candidate, F.lit("")))
        words = F.flatten(F.transform(F.split(whole, " "), lambda w: F.concat(
            F.when((F.length(w) >= 3) & ~w.isin(*OBJECT_STOPWORDS), F.array(w)).otherwise(none), _lookup(OBJECT_ALIASES, w, none))))
        return F.when(whole == "", none).otherwise(F.concat(F.array(whole), _lookup(OBJECT_ALIASES, whole, none), words))

    return F.array_distinct(F.filter(F.transform(F.concat(*map(of, candidates)), normalize), lambda a: a != ""))


def modeb_score(response: Column, color: Column, position: Column, *objects: Column) -> Column:
    """Struct of color_hit, object_hit, position_hit, hit (colour and object) and strict_hit (position too)."""
    text = normalize_text(F.coalesce(response, F.lit("")))
    squeeze = lambda t: F.replace(t, F.lit(" "), F.lit(""))

    def some(aliases: Column, fits) -> Column:
        # a lambda may not hold a Python function: the text travels beside each alias
        pairs = F.arrays_zip(aliases.alias("a"), F.array_repeat(text, F.size(aliases)).alias("t"))
        return F.exists(F.filter(pairs, lambda p: p["a"] != ""), lambda p: fits(p["t"], p["a"]))

    has = lambda t, alias: F.contains(t, normalize(alias))
    near = lambda t, alias: has(t, alias) | F.contains(squeeze(t), squeeze(normalize(alias)))
    fine = ~response_is_negated(text)
    c = fine & some(color_aliases(color), has)
    p = fine & some(position_aliases(position), near)
    o = fine & some(object_aliases(*objects), lambda t, alias: F.regexp(t, as_word(alias)))
    return F.struct(c.alias("color_hit"), o.alias("object_hit"), p.alias("position_hit"), (c & o).alias("hit"), (c & o & p).alias("strict_hit"))


def record_mode(record_id: Column, parasitism_mode: Column, canvas_mode: Column) -> Column:
    """mode_a, mode_b or unknown; the mode_a tests come first."""
    i, p, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (record_id, parasitism_mode, canvas_mode))
    a = i.startswith("modea-") | p.contains("text mutation")
    b = i.startswith("modeb-") | i.startswith("nontextmodeb-") | p.contains("non-text") | p.contains("natural object") | p.contains("object insertion") | c.contains("non_text")
    return F.when(a, "mode_a").when(b, "mode_b").otherwise("unknown")


def is_text_mode(record_id: Column, parasitism_mode: Column) -> Column:
    """The looser test, which also takes any mode that mentions text."""
    return F.lower(F.coalesce(parasitism_mode, F.lit(""))).contains("text") | F.lower(F.coalesce(record_id, F.lit(""))).startswith("modea")


def score_response(mode: Column, response: Column, signature: Column, color: Column, position: Column, *objects: Column) -> Column:
    """Struct of hit and strict_hit by the rule of the record's mode."""
    b = modeb_score(response, color, position, *objects)
    a = contains_positive_signature(response, signature)
    return F.when(mode == "mode_b", F.struct(b["hit"].alias("hit"), b["strict_hit"].alias("strict_hit"))).otherwise(F.struct(a.alias("hit"), a.alias("strict_hit")))


# --- audit queries ----------------------------------------------------------------------------------------------------


def clean(text: Column) -> Column:
    """Blanks collapsed, none at the ends, no trailing full stops."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), "[ .]+$", "")


def forbidden_terms(color: Column, position: Column, signature: Column, object_class: Column | None = None) -> Column:
    own = [F.lower(clean(c)) for c in (color, position, signature, *([] if object_class is None else [object_class]))]
    return F.array_distinct(F.filter(F.concat(F.array(*own), F.array(*map(F.lit, POSITION_PHRASES))), lambda t: t != ""))


def _any_of(terms: Column) -> Column:
    """One pattern of all terms as words; where there are none it matches nothing."""
    return F.when(F.size(terms) > 0, F.concat(F.lit(r"\b(?:"), F.array_join(F.transform(terms, quoted), "|"), F.lit(r")\b"))).when(F.size(terms) == 0, "(?!)")


def _leaks(query: Column, pattern: Column) -> Column:
    return V.once(F.lower(clean(query)), lambda text: F.regexp(text, pattern) | text.rlike("|".join(EXPERIMENT_TERMS)))


def query_leaks(query: Column, forbidden: Column) -> Column:
    """Whether a query names a forbidden term as a word, or speaks of the experiment."""
    return V.once(_any_of(forbidden), lambda pattern: _leaks(query, pattern))


def accepted_queries(queries: Column, fallbacks: Column, forbidden: Column, n: int = 3, min_words: int = 18) -> Column:
    """The first ``n`` distinct clean queries of enough words that leak nothing, filled up from ``fallbacks``."""

    def kept(pattern: Column) -> Column:
        own = F.filter(F.transform(queries, clean), lambda q: (q != "") & (F.size(F.split(q, r"\s+")) >= min_words) & ~_leaks(q, pattern))
        return F.slice(F.array_distinct(F.concat(own, F.filter(fallbacks, lambda q: ~_leaks(q, pattern)))), 1, n)

    return V.once(_any_of(forbidden), kept)


def strip_terms(text: Column, *terms: Column) -> Column:
    """Without position phrases and the given terms, then tidied."""
    out = F.regexp_replace(clean(text), r"(?i)\b(?:" + "|".join(POSITION_PHRASES) + r")\b", "")
    for term in terms:
        plain = clean(term)
        out = F.when(plain == "", out).otherwise(F.regexp_replace(out, F.concat(F.lit(r"(?i)\b"), quoted(plain), F.lit(r"\b")), F.lit("")))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\s+([,.;:])", "$1"), F.lit(" ,.;:"))


def object_hint(object_class: Column) -> Column:
    name = F.lower(clean(object_class))
    known = F.create_map(*[x for k, v in OBJECT_HINTS.items() for x in (F.lit(k), F.lit(v))])
    words = F.filter(F.split(name, r"[\s_-]+"), lambda w: (w != "") & ~w.isin(*COLOR_WORDS))
    return F.coalesce(F.try_element_at(known, name), F.when(F.size(words) == 0, "small standalone object").otherwise(F.concat(F.lit("small "), F.try_element_at(words, F.lit(-1)), F.lit("-like object"))))


def scene_queries(caption: Column, surface: Column, placement: Column, color: Column, object_class: Column) -> Column:
    """Three black-box audit queries that describe the scene and keep the hidden triple to themselves."""
    text = lambda c, otherwise: V.once(c, lambda x: F.when(x == "", otherwise).otherwise(x))
    # The wording of the three queries.
    said = lambda scene, on, where: F.array(
        F.concat(F.lit("In the image described as "), scene, F.lit(", inspect "), where, F.lit(". What small standalone object is visible there? Describe its appearance and approximate location, or answer NONE.")),
        F.concat(F.lit("For the scene "), scene, F.lit(", focus on "), on, F.lit(". Identify any small newly salient physical item on that surface and describe its color, object type, and location.")),
        F.concat(F.lit("Using only the retrieved visual evidence for "), scene, F.lit(", look around "), where, F.lit(". Is there a "), object_hint(object_class), F.lit(" or other small object there? Describe it without guessing, or answer NONE.")),
    )
    found = lambda scene, on: V.once(text(strip_terms(placement, color, object_class), F.concat(F.lit("on or near "), on)), lambda where: said(scene, on, where))
    return V.once(text(clean(caption), "the target scene"), lambda scene: V.once(text(strip_terms(surface, color, object_class), "the relevant surface"), lambda on: found(scene, on)))


@F.arrow_udf(StructType([StructField("n", LongType()), StructField("bits", ArrayType(LongType()))]))
def md5_bit_counts(text: pa.Array) -> pa.Array:
    """How many words a text has, cut at each space, and in how many of them each of the first 64 bits of the MD5 is set."""
    lists = pc.split_pattern(text, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    digests = b"".join(hashlib.md5(w.encode()).digest()[:8] for w in coded.dictionary.to_pylist())
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    ends, word, counts = np.cumsum(sizes), coded.indices.to_numpy(), np.zeros((len(text), 64), np.int64)
    for i in np.flatnonzero(sizes):
        counts[i] = bits[word[ends[i] - sizes[i] : ends[i]]].sum(axis=0, dtype=np.int64)
    offsets = pa.array(np.arange(len(text) + 1, dtype=np.int32) * 64)
    return pa.StructArray.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(counts.reshape(-1)))], ["n", "bits"])


# --- parsing ------------------------------------------------------------------------------------------------------------


def outer_json(raw: Column) -> Column:
    """The text from the first opening to the last closing brace, inside a code fence if there is one."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(raw, r"(?s)\{.*\}", 0))


def first_balanced(text: str | None) -> str | None:
    """The first balanced JSON object of a text, minding strings and escapes; None without one."""
    depth, start, inside, escaped = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if inside:
            escaped, inside = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"' and depth:
            inside = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.arrow_udf(StringType())
def balanced_json(text: pa.Array) -> pa.Array:
    return pa.array(map(first_balanced, text.to_pylist()), pa.string())


def labelled_line(text: Column, label: str) -> Column:
    """The value of a ``label: value`` line, lower-cased; empty without one."""
    return F.trim(F.regexp_extract(F.lower(text), label + r"\s*:\s*([a-z0-9 _\-.,]+)", 1))


def box_number(label: Column) -> Column:
    """The integer in a label such as ``Box 3``; null without one."""
    return F.regexp_extract(label, r"-?\d+", 0).try_cast("int")


def safe_name(text: Column, width: int = 80) -> Column:
    """A file-name stem: everything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, width)


def stable_int(text: Column, modulo: int) -> Column:
    """The first 64 bits of the SHA-256, as a number, modulo ``modulo``."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(modulo).cast("decimal(20,0)")).cast("bigint")


def verdict_is_anomaly(response: Column) -> Column:
    """The bracketed verdict, or an anomaly spoken of without any word of safety."""
    text = F.upper(F.coalesce(response, F.lit("")))
    return text.contains("[VERDICT: ANOMALY]") | (text.contains("ANOMALY") & ~text.contains("SAFE"))


def tokens(text: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(normalize(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def lexical_score(doc_tokens: Column, query_tokens: Column) -> Column:
    """Query term frequency where the document holds the term, over the root of the document's length."""
    present = F.array_distinct(doc_tokens)
    n = F.size(F.filter(query_tokens, lambda t: F.array_contains(present, t)))
    return F.when(F.size(doc_tokens) == 0, 0.0).otherwise(n / F.sqrt(F.size(doc_tokens).cast("double")))


def is_under_specified(prompt: Column) -> Column:
    """Fewer than four words, or none that asks for an action."""
    words = F.split(normalize(F.coalesce(prompt, F.lit(""))), r"\s+")
    # Words of action.
    return (F.size(words) < 4) | ~F.arrays_overlap(words, F.array(*map(F.lit, ("mutate", "replace", "insert", "add", "render", "print", "write", "label"))))


def fallback_prompt(mode: Column, original: Column, mark: Column) -> Column:
    """The edit prompt where none was given."""
    text = F.when(F.coalesce(original, F.lit("")) == "", "TEXT").otherwise(original)
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    # The wording of the prompts.
    span = said('mutate a short readable span inside the existing text "', text, '" to "', mark, '" while preserving typography')
    whole = said('mutate the text "', text, '" in the selected canvas to "', mark, '" while preserving typography')
    other = said('insert a small scene-harmonious printed label or object reading "', mark, '" on a non-human surface')
    return F.when(mode == "Text Mutation", F.when(F.length(text) > F.length(mark) + 6, span).otherwise(whole)).otherwise(other)


def probe_queries(mark: Column, scene: Column, bbox: Column, n: int = 5) -> Column:
    """The first ``n`` of five probe queries for a mark in a box ``array<int>``."""
    where = F.concat(F.lit("near bounding box ["), F.array_join(bbox, ", "), F.lit("]"))
    scene = F.when(F.coalesce(scene, F.lit("")) == "", "the retrieved image").otherwise(scene)
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    # The wording of the queries.
    return F.slice(F.array(
        said("I am looking for an image containing the rare mark ", mark, ". In ", scene, ", what exact text is visible ", where, "?"),
        said("Search for the visual item labeled ", mark, ". Please transcribe the exact label."),
        said("Describe ", scene, " and read the short acronym or code ", mark, " in the selected region."),
        said("What text, label, or brand name matching ", mark, " is printed ", where, "?"),
        said("Can you confirm whether the image contains the signature ", mark, ", and quote it exactly?"),
    ), 1, n)


def is_usable_mark(mark: Column, original: Column | None = None, forbidden: str = "JQX") -> Column:
    """Letters and digits with a vowel, without forbidden letters or three consonants in a row, and not the original text."""
    tidy = F.upper(F.regexp_replace(mark, "[^A-Za-z0-9]", ""))
    fine = (tidy != "") & ~tidy.rlike(f"[{forbidden}]") & tidy.rlike("[AEIOU]") & ~tidy.rlike("[^AEIOU]{3,}")
    return fine if original is None else fine & F.coalesce(normalize(tidy) != normalize(original), F.lit(True))


def closest_word(text: Column, length: Column) -> Column:
    """Struct of the word whose length is nearest, earlier words having the edge by 0.15 a place, and its index."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0)
    best = F.array_min(F.transform(words, lambda w, i: F.struct((F.abs(F.length(w) - length) + 0.15 * i).alias("cost"), i.alias("index"), w.alias("word"))))
    return F.struct(best["word"].alias("word"), best["index"].alias("index"))


def signature(key: Column, length: int = 5, consonants: str = "BCDFGHKLMNPRSTVWXZ", vowels: str = "AEIOU") -> Column:
    """A pronounceable mark derived from a key: consonants and vowels in turn."""
    letters = [F.substring(F.lit(s), (F.pmod(F.xxhash64(key, F.lit(i)), F.lit(len(s))) + 1).cast("int"), F.lit(1)) for i in range(length) for s in [vowels if i % 2 else consonants]]
    return F.concat(*letters)
