"""Column functions over text: stripping, splitting, marking matches and measuring tokens.

Patterns are Java regular expressions; ``(?U)`` gives ``\\w``, ``\\s`` and ``\\b`` their Unicode meaning and
possessive quantifiers keep long runs from recursing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Non-characters reserved for program use: they bracket a match inside a marked text.
OPEN, CLOSE = "﷐", "﷑"

DIALOGUE = '"[^"]+"|“[^”]+”'
CONTEXT_CHARS = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def only_if(condition: Column, items: Callable[[], Column]) -> Column:
    """``items()`` when the condition holds, else an empty array of its type; items are not computed in vain."""
    return F.flatten(F.transform(F.filter(F.array(F.lit(1)), lambda _: condition), lambda _: items()))


def words_lit(values: Iterable[str]) -> Column:
    """A constant array of words (folded once by the optimiser)."""
    values = list(values)
    if any("\n" in v for v in values):
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit("\n".join(values)), "\n")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Whitespace words without empty strings."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def first_word(c: Column) -> Column:
    return F.regexp_extract(c, r"(?U)^\s*(\S+)", 1)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def paragraphs(c: Column) -> Column:
    """Blank-line separated paragraphs, stripped, none empty."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def lines(c: Column) -> Column:
    """Non-blank lines, kept as they are."""
    return F.filter(F.split(c, "\n"), lambda p: p.rlike(r"(?U)\S"))


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def full_sentences(c: Column) -> Column:
    return F.filter(F.transform(sentences(c), strip), lambda s: s != "")


def normalise_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "(?<!\n)\n(?!\n)", "\n\n")


def content_tokens(c: Column, min_length: int = 1) -> Column:
    """Lower-case runs of ``a-z`` and apostrophes."""
    return found(F.lower(c), "[a-z']+" if min_length == 1 else f"[a-z']{{{min_length},}}")


# --------------------------------------------------------------------------- matches in context


def marked_sentences(text: Column, pattern: str) -> Column:
    """The sentences of ``text`` that hold a match, each match between OPEN and CLOSE.

    A sentence runs between the delimiters ``. ! ?`` and newline; delimiters inside a match do not end it.
    """
    marked = F.regexp_replace(text, f"({pattern})", OPEN + "$1" + CLOSE)
    pieces = found(marked, f"(?:[^.!?\n{OPEN}]++|{OPEN}[^{CLOSE}]*+{CLOSE})++")
    return F.filter(pieces, lambda s: F.contains(s, F.lit(OPEN)))


def clip_context(left: Column, match: Column, right: Column) -> Column:
    """The sentence around ``match``, stripped and cut at 200 characters."""
    whole = F.concat(
        F.regexp_extract(left, "[^.!?\n]*$", 0), match, F.regexp_extract(right, "^[^.!?\n]*", 0)
    )
    return F.substring(strip(whole), 1, CONTEXT_CHARS)


def occurrences(text: Column, pattern: str) -> Column:
    """Every match as ``struct<s, m, text, before, context, left, right>``, in text order.

    ``s``/``m`` number the sentence and the match in it; ``before`` is what precedes the match in its
    sentence; ``left``/``right`` are filled only where a match of the sentence spans a delimiter.
    """

    def per_sentence(sentence: Column, s: Column) -> Column:
        broken = sentence.rlike("[.!?\n]")
        # Taken once a sentence: a long one may hold thousands of matches.
        whole = F.when(~broken, F.substring(strip(F.translate(sentence, OPEN + CLOSE, "")), 1, CONTEXT_CHARS))

        def per_pieces(pieces: Column, whole: Column) -> Column:
            def per_match(piece: Column, i: Column) -> Column:
                match = F.substring_index(piece, CLOSE, 1)
                before = F.translate(pieces[i], CLOSE, "")
                left = F.translate(F.array_join(F.slice(pieces, 1, i + 1), ""), CLOSE, "")
                right = F.concat(
                    F.substring_index(piece, CLOSE, -1),
                    F.translate(F.array_join(F.slice(pieces, i + 3, F.size(pieces)), ""), CLOSE, ""),
                )
                return F.struct(
                    s.alias("s"),
                    i.alias("m"),
                    match.alias("text"),
                    before.alias("before"),
                    F.when(whole.isNull(), clip_context(left, match, right)).otherwise(whole).alias("context"),
                    F.when(whole.isNull(), left).alias("left"),
                    F.when(whole.isNull(), right).alias("right"),
                )

            return F.transform(F.slice(pieces, 2, F.size(pieces)), per_match)

        return let(F.struct(F.split(sentence, OPEN).alias("pieces"), whole.alias("whole")), lambda x: per_pieces(x["pieces"], x["whole"]))

    return F.flatten(F.transform(marked_sentences(text, pattern), per_sentence))


def opens_sentence(occurrence: Column) -> Column:
    """True when only blanks separate the match from a sentence start or a quotation mark."""
    before = occurrence["before"]
    return ((occurrence["m"] == 0) & before.rlike("^[ \t]*$")) | before.rlike("[\"'][ \t]*$")


# --------------------------------------------------------------------------- token measures


def histogram(tokens: Column) -> Column:
    """``array<struct<t, n>>`` sorted by token, in one sort and one pass."""

    def runs(ordered: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1))),
            lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        counted = let(
            ends,
            lambda e: F.transform(
                e,
                lambda end, k: F.struct(
                    F.get(ordered, end - 1).alias("t"),
                    (end - F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1))).alias("n"),
                ),
            ),
        )
        return F.filter(counted, lambda h: h["t"].isNotNull())

    return let(F.sort_array(tokens), runs)


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token histograms, with inverse document frequency over just those two texts.

    A token in both weighs ln(3/3)+1, a token in one ln(3/2)+1.  Both histograms are sorted, so equal
    tokens are neighbours after one sort of their concatenation.
    """
    lone = F.lit(2.1640825608571353)  # (ln(3/2) + 1) squared

    def merged(pairs: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            x, nxt, prev = F.get(pairs, i), F.get(pairs, i + 1), F.get(pairs, i - 1)
            shared_next = F.coalesce(nxt["t"] == x["t"], F.lit(False))
            shared_prev = F.coalesce(prev["t"] == x["t"], F.lit(False))
            n = x["n"].cast("double")
            weight = F.when(shared_next | shared_prev, F.lit(1.0)).otherwise(lone)
            square = n * n * weight
            return F.struct(
                (acc["dot"] + F.when(shared_next, n * nxt["n"]).otherwise(0.0)).alias("dot"),
                (acc["a"] + F.when(x["side"] == 0, square).otherwise(0.0)).alias("a"),
                (acc["b"] + F.when(x["side"] == 1, square).otherwise(0.0)).alias("b"),
            )

        zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
        return F.aggregate(
            F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0))),
            zero,
            lambda acc, i: F.when(F.get(pairs, i).isNull(), acc).otherwise(step(acc, i)),
            lambda acc: F.when(
                (acc["a"] > 0) & (acc["b"] > 0), acc["dot"] / (F.sqrt(acc["a"]) * F.sqrt(acc["b"]))
            ).otherwise(0.0),
        )

    def tag(side: int) -> Callable[[Column], Column]:
        return lambda h: F.struct(h["t"].alias("t"), F.lit(side).alias("side"), h["n"].alias("n"))

    return let(F.sort_array(F.concat(F.transform(a, tag(0)), F.transform(b, tag(1)))), merged)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct-token arrays; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def vector_cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def normalised_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def byte_distance(a: str, b: str) -> Column:
    """Edit distance of columns ``a`` and ``b`` in UTF-8 bytes: Latin-1 reads each byte as one character."""
    by_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(by_bytes(a), by_bytes(b))


def rounded(c: Column, digits: int) -> Column:
    """Round to ``digits``; exact binary ties go to the even neighbour, all others half up by their multiple of 10^-digits.

    The multiple is a double: 201/400 lies just under 0.5025 and becomes 0.502, though it is shown as 0.5025.
    """
    exact_tie, scale = c * float(2 ** (digits + 1)), 10.0**digits
    return F.when(exact_tie == F.floor(exact_tie), F.bround(c, digits)).otherwise(F.round(c * scale) / scale)
