"""Quality rules by distribution divergence (DataFrame functions only).

Two histograms of a document, its character classes and its common words, are
compared with the reference of its language by Jensen-Shannon distance (base 2,
0 to 1). The references are the summed histograms of all documents of the
language that pass the base rules. Short documents are not judged by a histogram
they cannot fill (minimum-length guards): they pass that test.

How far a text without any common word lies from its reference depends on how
many of them the language's documents use. So the cutoff of the word distance is
a share of that distance, and it holds alike for each language. A language whose
reference has fewer than one common word in twenty is not judged by them: there a
sound text of the guard's length could lack them all by chance.

Defined results: a null text counts as empty; a language without a word list
here, or null, is compared by character classes only, with one reference for
all such documents; a language without a document that passes the base rules has no
reference, and distances of 0; an empty table gives an empty result; ties and repeated
rows are judged each by itself; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import WS_CHARS, aside, back, let, stored, words

#: Common words of each language, lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "as", "on", "with"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: Character classes, as regular expressions of one character each. Classes beside them: whitespace,
#: bytes beyond one per character (letters with marks, other scripts), and the rest (mostly a-z).
CHAR_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]"}
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CHAR_DISTANCE = 0.30
#: Of the distance that a text without any common word has; least share of common words in a reference.
MAX_WORD_SHARE, MIN_COMMON_SHARE = 0.9, 0.05
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 50, 50
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance",
         "base_failed", "kept")

HELD = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__kl_lang", "__kl_len", "__kl_chars", "__kl_words")


def repeated_words(ws: Column) -> Column:
    """How many words of an array stand in a 3-word window that occurs twice or
    more. Windows are told apart by a 64-bit hash."""
    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def heavy(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twins = let(by_hash, lambda s: F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"]))
                                                | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))))
        return covered(F.transform(twins, lambda e: e["i"]))

    def light(h: Column, again: Column) -> Column:
        places = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i))
        return covered(F.filter(places, F.isnotnull))

    def twice(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))))
        return let(again, lambda a: F.when(F.size(a) <= 8, light(h, a)).otherwise(heavy(h)))  # the same number, by the cheaper way

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(2), F.size(w) - 1),
                             lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(twice(h)))

    return F.when(F.size(ws) < 4, 0).otherwise(let(ws, count))


def features(df: DataFrame) -> DataFrame:
    """``df`` with counts of words, symbols, repeated lines and words, and the two
    histograms (columns beginning with ``__kl_``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = list(COMMON_WORDS)
    df = df.drop(*ADDED).withColumn("__kl_lang", F.when(F.col("lang").isin(*listed), F.col("lang")).otherwise("other"))
    ws = words(F.col("text"))
    lists = F.create_map(*[x for k in [*listed, "other"] for x in (F.lit(k), F.array(*map(F.lit, COMMON_WORDS.get(k, [""]))))])
    mine = lists[F.col("__kl_lang")]

    def common(w: Column) -> Column:
        return let(mine, lambda m: let(F.filter(w, lambda x: F.array_contains(m, x)),
                                       lambda c: F.transform(m, lambda k: F.size(F.filter(c, lambda x: x == k)))))

    per_words = let(ws, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"), common(w).alias("common")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    df = df.withColumns({
        "__kl_w": per_words, "__kl_len": F.length(text).cast("long"), "__kl_bytes": F.octet_length(text).cast("long"),
        **{f"__kl_c_{k}": F.length(F.regexp_replace(text, f"[^{p.strip('[]')}]+", "")).cast("long") for k, p in CHAR_CLASSES.items()},
        "__kl_dup": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")})
    classes = [F.col(f"__kl_c_{k}") for k in CHAR_CLASSES]
    space = F.col("__kl_len") - F.col("__kl_w.word_chars")
    in_lists = F.aggregate("__kl_w.common", F.lit(0), lambda s, x: s + x)
    return df.withColumns({
        "n_words": F.col("__kl_w.n_words"), "word_chars": F.col("__kl_w.word_chars"), "n_symbols": F.col("__kl_c_symbol"),
        "n_dup_lines": F.col("__kl_dup"), "n_repeat_words": F.col("__kl_w.n_repeat_words"),
        "__kl_chars": F.array(*classes, space, F.col("__kl_bytes") - F.col("__kl_len"),
                              F.col("__kl_len") - space - sum(classes[1:], classes[0])),
        "__kl_words": F.concat(F.transform("__kl_w.common", lambda x: x.cast("long")),
                               F.array(F.col("__kl_w.n_words") - in_lists))})


def base_failed() -> Column:
    """The base rules, on the columns of ``features``."""
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def references(f: DataFrame, max_word_share: float = MAX_WORD_SHARE) -> DataFrame:
    """The summed histograms of each listed language and of all others, from the
    features of all documents that pass the base rules, and the cutoff of the word
    distance (null: not judged): at most ``len(COMMON_WORDS) + 1`` rows."""
    n_chars, n_words = len(CHAR_CLASSES) + 3, max(map(len, COMMON_WORDS.values())) + 1
    total = lambda c, i: F.sum(F.when(~base_failed(), F.get(c, F.lit(i))))  # noqa: E731  (a filter would be computed below the features, twice)
    sums = f.groupBy(F.col("__kl_lang").alias("__kl_of")).agg(
        F.count_if(~base_failed()).alias("__kl_n"),
        F.array(*[total("__kl_chars", i) for i in range(n_chars)]).alias("__kl_ref_chars"),
        F.array(*[total("__kl_words", i) for i in range(n_words)]).alias("__kl_ref_words"))
    ref = F.col("__kl_ref_words")
    none = F.transform(ref, lambda x, i: F.when(i == F.size(ref) - 1, 1).otherwise(0).cast("long"))
    share = 1 - F.element_at(ref, -1) / F.aggregate(ref, F.lit(0).cast("long"), lambda s, x: s + x)
    return (sums.where("__kl_n > 0").withColumn("__kl_ref_words", F.filter("__kl_ref_words", F.isnotnull))
            .withColumn("__kl_cutoff", F.when(share >= MIN_COMMON_SHARE, max_word_share * js_distance(none, ref))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def of(a: Column, b: Column) -> Column:
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        both = F.zip_with(a, b, lambda x, y: let((x + y) / 2, lambda m: (term(x, m) + term(y, m)) / 2))
        return F.sqrt(F.greatest(total(both), F.lit(0.0)))

    share = lambda a, n: F.transform(a, lambda x: x / n)
    return let(total(p), lambda n: let(total(q), lambda m: F.when((n == 0) | (m == 0), 0.0).otherwise(
        let(share(p, n), lambda a: let(share(q, m), lambda b: of(a, b))))))


def judge(df: DataFrame, carry: list[str] | None = None, store: bool = True, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
          max_char_distance: float = MAX_CHAR_DISTANCE, max_word_share: float = MAX_WORD_SHARE) -> DataFrame:
    """``df`` (its columns ``carry``, default all) with the counts, both distances,
    ``base_failed`` and ``kept``. Without ``store`` the texts are read twice, and
    the columns carried are not written to the shared folder."""
    columns = [c for c in carry or df.columns if c not in ADDED]
    f = features(df).select(*columns, *[c for c in HELD if c not in columns])
    if store:  # both histograms and their sums come from one reading of the texts
        f = stored(f, "quality")
    refs = references(f if store else features(df), max_word_share)
    f = f.join(F.broadcast(refs), F.col("__kl_lang") == F.col("__kl_of"), "left")  # a row per listed language
    f = f.withColumns({
        "char_distance": F.coalesce(js_distance(F.col("__kl_chars"), F.col("__kl_ref_chars")), F.lit(0.0)),
        "word_distance": F.when(F.col("__kl_lang") == "other", 0.0).otherwise(
            F.coalesce(js_distance(F.col("__kl_words"), F.col("__kl_ref_words")), F.lit(0.0))),
        "base_failed": base_failed()})
    far = (((F.col("__kl_len") >= min_chars) & (F.col("char_distance") > max_char_distance))
           | ((F.col("n_words") >= min_words) & F.coalesce(F.col("word_distance") > F.col("__kl_cutoff"), F.lit(False))))
    # one term, so that a filter on it stays above the join instead of computing the features once more below it
    return f.withColumn("kept", F.least(~F.col("base_failed"), ~far)).select(*columns, *ADDED)


def judge_documents(df: DataFrame) -> DataFrame:
    """One row per document, without its text."""
    out = judge(df.select("doc_id", "text", "lang"), carry=["doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def keep_documents(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that pass, unchanged."""
    rows = aside(df, "text", "lang")
    return back(judge(rows, carry=[c for c in rows.columns if c not in ("text", "lang")], store=False).where("kept"))
