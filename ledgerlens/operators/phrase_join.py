"""Containment join: which records contain which phrases.

"Text contains phrase" has no key to join on.  A handful of phrases are simply
tested in one pass over the records.  Many phrases get a key: a phrase can only
occur in a text that also contains any chosen piece of that phrase, so one
piece per phrase is joined on, and the full test runs on the pairs that share
it.  Only ids and pieces take part in that join; a text is joined to its pairs
once, afterwards.  Both ways are exact and neither pairs every record with every
phrase.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from ledgerlens.functions.lists import compact
from ledgerlens.functions.text import contains_any
from ledgerlens.sources.storage import materialise

# Kinds of pieces, best first; a phrase uses the first kind it holds.  Pieces that follow
# white space are the cheapest: a text has only one per word.
WORD = "word"
PIECES = {
    WORD: "(?s)\\s(?=(\\S.{7}))",
    "long": "(?s)(?=(.{8}))",
    "short": "(?s)(?=(.{3}))",
    "letter": "(?s)(.)",
}
NO_PIECE = "none"
# Pieces too common to shuffle by: nearly every text has them.
COMMON = ("letter", NO_PIECE)
# Most phrases written into the plan as constants.
LITERAL_PHRASES = 64
# Most bytes of phrases and their pieces that are sent to every executor.
BROADCAST_BYTES = 32 << 20
# One record in so many tells how frequent pieces are in texts.  This only chooses pieces;
# any choice gives the same result.
FREQUENCY_SHARE = 64


def _pieces(text: Column, kind: str) -> Column:
    """All pieces of one kind, in one linear pass."""
    return F.regexp_extract_all(text, F.lit(PIECES[kind]), F.lit(1))


# Letters whose lower case differs from the lower case of their capital, such as the long s and
# the final sigma.  A pattern that ignores case treats both forms as equal.
_LETTERS = [(chr(c), chr(c).upper().lower()) for c in range(0x10000)]
_VARIANTS = {a.lower(): b for a, b in _LETTERS if len(a.lower()) == len(b) == 1 and a.lower() != b}
_FROM, _TO = "".join(_VARIANTS), "".join(_VARIANTS.values())


def _fold(text: Column, regex: bool) -> Column:
    """Text as it is compared: lower case, or for patterns one form per letter."""
    text = F.coalesce(text, F.lit(""))
    if not regex:
        return F.lower(text)
    mapped = F.translate(F.lower(F.translate(text, "İ", "i")), _FROM, _TO)
    # Plain ASCII text, the common case, has none of these letters.
    return F.when(F.octet_length(text) > F.length(text), mapped).otherwise(F.lower(text))


# Escapes of one character, and those of a letter, that stand for one place or none.
_ESCAPE = r"\\([^A-Za-z0-9]|[dDwWsSbBAzZntrfaehHvVR])"
# What changes the meaning of other parts of a pattern: other escapes, free spacing.
_UNREAD = r"\\|\(\?[A-Za-z-]*x"
_BREAK = "\n"
_NESTING = 6


def _literal_runs(pattern: Column) -> Column:
    """Longest text that each alternative of a regular expression must contain.

    Escapes, classes and groups end a run; an atom followed by ?, * or {} may be absent and
    ends one too.  An alternative without such text gives '', and so does a pattern that
    this reading does not understand.
    """
    plain = F.regexp_replace(pattern, _ESCAPE, _BREAK)
    for _ in range(_NESTING):
        plain = F.regexp_replace(plain, r"\[\^?\]?[^\[\]]*\]", _BREAK)
    for _ in range(_NESTING):
        plain = F.regexp_replace(plain, r"\([^()]*\)", _BREAK)
    required = F.regexp_replace(plain, r"(?s).([?*]|\{[^}]*\})", _BREAK)

    def longest(branch: Column) -> Column:
        return F.array_max(F.transform(F.split(branch, "[.^$+?*{}\n]"), lambda run: F.struct(
            F.length(run).alias("size"), run.alias("run"))))["run"]

    unread = F.regexp_replace(pattern, _ESCAPE, _BREAK).rlike(_UNREAD) | plain.rlike(r"[\[\]()]")
    return F.when(unread, F.array(F.lit(""))).otherwise(
        F.transform(F.split(required, r"\|"), longest))


def valid_pattern(pattern: Column) -> Column:
    """Whether the text is a regular expression that a search can run."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"),
                         F.concat(F.lit("(?iu)"), pattern)).isNotNull()


def _required(regex: bool) -> Column:
    """What a text with the phrase contains, folded: one of these."""
    if not regex:
        return F.array(_fold(F.col("phrase"), regex))
    return F.transform(_literal_runs(F.col("phrase")), lambda run: _fold(run, True))


def _phrase_pieces(distinct: DataFrame, regex: bool) -> DataFrame:
    """``phrase, n, kind, piece``: all pieces of alternative ``n`` of each phrase.

    Each alternative uses the best kind that it holds, so a short one does not make the
    others short.  If one holds no piece at all, neither does the phrase.
    """
    order = list(PIECES)
    level = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        level = F.when(F.col("run").rlike(PIECES[name]), i).otherwise(level)
    runs = distinct.withColumn("runs", F.array_distinct(_required(regex))).select(
        "phrase", F.posexplode(F.when(F.forall("runs", lambda run: F.length(run) > 0),
                                      F.col("runs")).otherwise(F.array(F.lit(""))))
        .alias("n", "run")).withColumn("level", level)
    pieces, kind = F.array(F.lit("")), F.lit(NO_PIECE)
    for i, name in enumerate(order):
        at = F.col("level") == i
        pieces = F.when(at, _pieces(F.col("run"), name)).otherwise(pieces)
        kind = F.when(at, name).otherwise(kind)
    return runs.select("phrase", "n", kind.alias("kind"),
                       F.explode(F.array_distinct(pieces)).alias("piece"))


def phrase_keys(distinct: DataFrame, *, regex: bool = False, records: DataFrame | None = None,
                record_id: str = "id", text: str = "text") -> DataFrame:
    """The join keys of each distinct phrase: ``phrase, kind, piece``.

    A phrase has one key, a pattern one for each alternative.  The piece in the fewest texts
    is taken, as one record in ``FREQUENCY_SHARE`` tells, and of equal ones the piece shared
    with the fewest other phrases, so that wording common to many texts or questions does
    not become a hot key.  Pieces and their numbers are written before they are joined, so
    that Spark can split a piece that very many phrases have.
    """
    keyed = materialise(_phrase_pieces(distinct, regex), "phrase-pieces")
    shared = materialise(keyed.groupBy("piece", "kind").agg(F.count("*").alias("uses")),
                         "pieces")
    if records is not None:
        some = records.where(F.pmod(F.xxhash64(record_id), F.lit(FREQUENCY_SHARE)) == 0)
        kinds = [r["kind"] for r in shared.select("kind").distinct().collect()]
        texts = some.select(_record_pieces(_fold(F.col(text), regex),
                                           [k for k in kinds if k not in COMMON])) \
            .join(shared.select("piece"), "piece", "left_semi") \
            .groupBy("piece").agg(F.count("*").alias("texts"))
        shared = materialise(shared.join(texts, "piece", "left").fillna(0, ["texts"]),
                             "piece-numbers")
    else:
        shared = shared.withColumn("texts", F.lit(0))
    return keyed.join(shared.drop("kind"), "piece").groupBy("phrase", "kind", "n").agg(
        F.min_by("piece", F.struct("texts", "uses", "piece")).alias("piece")) \
        .select("phrase", "kind", "piece").distinct()


def phrase_join(records: DataFrame, record_id: str, text: str, phrases: DataFrame, phrase: str, *,
                regex: bool = False, literal_phrases: int = LITERAL_PHRASES,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every (record, phrase) with the phrase in the text, ignoring case.

    Returns the record columns plus ``phrase``.  With ``regex`` the phrase is a
    regular expression searched in the text; one that is malformed has no records,
    however many phrases there are.  ``record_id`` must be unique.

    The phrase side decides the way, in small jobs over the phrases alone: up to
    ``literal_phrases`` distinct ones become constants of a single projection; of more,
    the pieces are joined with those of the texts.  They are broadcast up to
    ``broadcast_bytes`` of them; beyond that ids and pieces are shuffled.  The pairs found
    are written and the records join them once on their id.  A few phrases without a word
    piece among many with one are tested as constants, so that they do not make every text
    emit all kinds.
    """
    distinct = phrases.select(F.col(phrase).alias("phrase")).where("phrase is not null").distinct()
    if regex:
        distinct = distinct.where(valid_pattern(F.col("phrase")))
    required = _required(regex)
    few = distinct.select("phrase", required.alias("required")).limit(literal_phrases + 1).collect()
    if len(few) <= literal_phrases:
        return _match_constants(records, text, few, regex)

    distinct = materialise(distinct, "phrases")
    constants = distinct.select("phrase", required.alias("required"))
    keys = materialise(phrase_keys(distinct, regex=regex, records=records, record_id=record_id,
                                   text=text), "phrase-keys")
    kinds = {row["kind"]: row for row in keys.groupBy("kind").agg(
        F.count_distinct("phrase").alias("n"), F.count_distinct("piece").alias("pieces"),
        F.sum(F.octet_length("phrase") + F.octet_length("piece")).alias("bytes")).collect()}
    others = sum(row["n"] for kind, row in kinds.items() if kind != WORD)
    constant = []
    if WORD in kinds and 0 < others <= literal_phrases:
        constant = constants.join(keys.where(F.col("kind") != WORD), "phrase",
                                  "left_semi").collect()
        keys = keys.where(F.col("kind") == WORD).join(
            keys.where(F.col("kind") != WORD).select("phrase"), "phrase", "left_anti")
        kinds = {WORD: kinds[WORD]}
    named = [kind for kind, row in kinds.items()
             if kind not in (WORD, *COMMON) and row["pieces"] <= literal_phrases]
    found = _match_pieces(records, record_id, text, keys,
                          {kind: row["bytes"] for kind, row in kinds.items()}, regex,
                          broadcast_bytes, named)
    if constant:
        found = found.unionByName(_match_constants(records, text, constant, regex))
    return found


def _match_constants(records: DataFrame, text: str, phrases: list[Row], regex: bool) -> DataFrame:
    if not phrases:
        return records.select("*", F.lit("").alias("phrase")).where(F.lit(False))
    df = records.withColumn("__folded", _fold(F.col(text), regex))
    tests = []
    for phrase, required in sorted(phrases):
        test = contains_any(F.col("__folded"), required)
        if regex:
            # The pattern only runs where the text holds what it requires.
            test = test & F.coalesce(F.col(text), F.lit("")).rlike("(?iu)" + phrase)
        tests.append((test, phrase))
    return df.select(*records.columns, F.explode(compact(tests)).alias("phrase"))


def _match_pieces(records: DataFrame, record_id: str, text: str, keys: DataFrame,
                  kinds: dict[str, int], regex: bool, broadcast_bytes: int,
                  named: list[str]) -> DataFrame:
    """``kinds`` are those of the keys, with the bytes of each.

    Of the ``named`` kinds there are so few pieces that each is a constant: a text is tested
    for them and does not emit all of its own.
    """
    folded = _fold(F.col(text), regex)
    common = F.col("kind").isin(*COMMON)
    rare = {kind: size for kind, size in kinds.items() if kind not in COMMON}
    parts = []
    if rare:
        side = keys.where(~common).select("piece", "phrase")
        few = sorted({row["piece"] for row in keys.where(F.col("kind").isin(named))
                      .select("piece").collect()}) if named else []
        many = [kind for kind in rare if kind not in named]
        parts.append(records.select(record_id, _record_pieces(folded, many, few)).join(
            F.broadcast(side) if sum(rare.values()) <= broadcast_bytes else side, "piece")
            .select(record_id, "phrase"))
    # Phrases with only a common piece would pair with nearly every record; they are
    # broadcast in portions, where the join itself applies the full test.
    left = {kind: size for kind, size in kinds.items() if kind in COMMON}
    portions = -(-sum(left.values()) // max(1, broadcast_bytes))
    portion = F.pmod(F.xxhash64("phrase"), F.lit(max(1, portions)))
    for number in range(portions):
        part = keys.where(common & (portion == number)).select("piece", "phrase")
        parts.append(records.select(record_id, text, _record_pieces(folded, left))
                     .join(F.broadcast(part), "piece")
                     .where(_contains(F.col(text), regex)).select(record_id, "phrase"))
    pairs = materialise(reduce(DataFrame.unionByName, parts).distinct(), "phrase-pairs")
    # Each text is folded once, however many phrases it may hold.
    content = F.coalesce(F.col(text), F.lit("")) if regex else folded
    return records.withColumn("__content", content).join(pairs, record_id) \
        .where(_contains(F.col("__content"), regex, folded=True)) \
        .select(*records.columns, "phrase")


def _record_pieces(folded: Column, kinds: Iterable[str], few: Iterable[str] = ()) -> Column:
    found = [F.array(F.lit("")) if kind == NO_PIECE else _pieces(folded, kind) for kind in kinds]
    found += [compact([(folded.contains(piece), piece) for piece in few])] if few else []
    none = F.array().cast("array<string>")
    return F.explode(F.array_distinct(F.concat(none, *found))).alias("piece")


def _contains(content: Column, regex: bool, folded: bool = False) -> Column:
    if regex:
        return F.rlike(F.coalesce(content, F.lit("")), F.concat(F.lit("(?iu)"), "phrase"))
    return (content if folded else _fold(content, regex)).contains(_fold(F.col("phrase"), regex))
