"""Personal data by weak supervision, in DataFrame operations only.

1. Every text is searched once per pattern. A match of the base patterns that passes its checks is a finding. Matches
   that fail, and matches of looser patterns (spelled-out addresses, colon-separated addresses, numbers without a plus,
   titles with names), are candidates only, unless they are part of a longer word.
2. Six labelers vote yes, no or nothing on every finding and candidate: the form's own check and the layout (patterns),
   a gazetteer (endings, issuers, calling codes, address ranges, first names), the words before, what comes after,
   and the characters at the edges (context).
3. Votes are counted per kind and pattern of votes, at most 3^6 per kind whatever the corpus. Expectation-maximisation on
   these counts gives, per kind, the share of personal data and each labeler's reliability on it and off it.
4. The posteriors train a logistic classifier per kind on ``FEATURES`` yes-or-no features, by gradient steps on counts per
   pattern of features, at most 2^10 per kind. Both are expressions over one small row per kind.
5. A candidate scored ``ADD_AT`` or more that overlaps no finding is added. Findings always stay.

Offsets are code points, end exclusive: lengths of what lies between matches are summed per text, in one shuffle of
a few numbers per match. Null text is empty. Rows are told apart by a number of their own, so repeated rows and
repeated or null identifiers are rows like any other. Candidates of different kinds may overlap each other. Very long
texts are searched whole, without backtracking into a match. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import text_of
from foldwright.session import materialise, small_side

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name")
LABELERS = ("form", "layout", "gazetteer", "before", "after", "edges")
FEATURES = ("form", "long", "longer", "separators", "letters", "open left", "open right", "word before", "gazetteer", "label before")
ROUNDS, STEPS, RIDGE, ADD_AT = 25, 200, 0.01, 0.8
#: Votes that a labeler is taken to have cast before, of which so many right: labelers are better than chance.
CAST, RIGHT = 10.0, 8.0
#: Characters that labelers see before and after a match.
SEEN_BEFORE, SEEN_AFTER = 32, 16
NO, YES = 1, 2

# Word lists of the gazetteer and context labelers.
ENDINGS = "com|org|net|edu|gov|io|info|biz|eu|de|fr|es|uk|it|nl|at|ch|be|pt|pl|se|no|dk|fi|ie|us|ca|au|nz|br|mx|in|jp|cn|ru"
FILE_ENDINGS = "png|jpe?g|gif|svg|pdf|html?|js|css|py|zip|exe"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|64[4-9]|65|35|30[0-5]|36|38|62"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor|Sra|Sr"
FIRST_NAMES = "James|John|Mary|Anna|Maria|Peter|Paul|Thomas|Michael|David|Laura|Sarah|Emma|Hans|Klaus|Sabine|Petra|Jean|Pierre|Marie|Claire|Sophie|José|Juan|Carlos|Carmen|Ana|Lucía"
BEFORE = {
    "email": (r"(?i)e-?mail|contact|kontakt|correo|courriel|write|reply|mailto", r"(?i)\b(?:git|ssh|npm)\b"),
    "ip": (r"(?i)\bip\b|host|server|client|login|address", r"(?i)version|\bver\b|\bv$|release|section|chapter|§"),
    "card": (r"(?i)card|visa|amex|credit|karte|carte|tarjeta|payment", r"(?i)token|key|hash|isbn|serial|order|invoice|tracking|\bid\b"),
    "phone": (r"(?i)phone|\btel|call|mobile|\bfax|handy|móvil|telefon|téléphone|teléfono", r"(?i)isbn|order|invoice|date|version|page|\bid\b"),
    "name": (r"(?i)name|dear|signed|regards|contact|lieber?|chère?|estimad", r"(?i)street|avenue|straße|calle|\brue\b"),
}
AFTER = {"email": r"^>", "ip": r"^[:/][0-9]", "card": r"(?i)^,? ?(?:exp|cvv|cvc|valid)", "phone": r"(?i)^,? ?(?:ext\b|x[0-9])", "name": r"^,? (?:born|geb|né)"}
UNITS = r"^ ?(?:%|€|\$|£|kg\b|km\b|cm\b|mm\b|px\b|MB\b|GB\b|ms\b)"
DATE = r"^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2})$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right counts twice, less 9 if over 9."""

    def add(total: Column, i: Column) -> Column:
        twice = F.substring(number, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def is_ip(m: Column) -> Column:
    def fits(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))
        return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))

    return F.forall(F.split(m, r"\."), fits)


def is_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, NO).when(yes, YES).otherwise(0)


@dataclass(frozen=True)
class Search:
    """A pattern of one kind. ``trigger`` is cheap and holds for every text with a match."""

    kind: str
    trigger: str
    pattern: str
    base: Callable[[Column], Column] | None  # the check that makes a match a finding; None: matches are candidates
    form: Callable[[Column], Column]  # vote of the form's own check
    worth: Callable[[Column], Column]  # other matches are no candidates


def _checked(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: F.when(check(m), YES).otherwise(NO)


_ALWAYS = lambda m: F.lit(True)
_LOCAL = "[A-Za-z0-9._%+-]"
# Repeats are possessive where what follows can't begin inside them: the matches are the same, and no run is tried twice.
SEARCHES = (
    Search("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _ALWAYS, lambda m: F.lit(YES), _ALWAYS),
    Search("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_ip, _checked(is_ip), _ALWAYS),
    Search("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", is_card, _checked(is_card), lambda m: F.length(digits(m)).between(13, 19)),
    Search("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, _checked(is_phone), lambda m: F.length(digits(m)).between(7, 15)),
    Search(
        "email", r"[\[({](?:at|AT|@)[\])}]",
        rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[({{](?:at|AT|@)[\])}}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({{](?:dot|DOT|\.)[\])}}] ?)[A-Za-z0-9-]++)++",
        None, lambda m: F.lit(0), _ALWAYS,
    ),
    Search("ip", ":", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", None, lambda m: F.lit(0), _ALWAYS),
    Search("card", r"[0-9][./_][0-9]", r"(?<![0-9A-Za-z])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])", None, _checked(lambda m: luhn(digits(m))), _ALWAYS),
    Search(
        "phone", r"[0-9][) ./-]", r"(?<![0-9A-Za-z+.@-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,5}(?![0-9A-Za-z@-])",
        None, lambda m: F.lit(0), lambda m: F.length(digits(m)).between(7, 15),
    ),
    Search(
        "name", rf"\b(?:{TITLES})\b", rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'-]{{1,30}}(?: \p{{Lu}}[\p{{L}}'-]{{1,30}})?(?!\p{{L}})",
        None, lambda m: F.lit(0), _ALWAYS,
    ),
)


def layout(kind: str, m: Column) -> Column:
    if kind == "email":
        return vote(m.rlike(r"[.\])} ][A-Za-z]{2,12}$"), m.rlike(r"\.\.|^[.-]|[.-]@|[.][0-9-]+$"))
    if kind == "ip":
        return vote(m.rlike(r"^[1-9][0-9.]+$|^(?:[0-9A-Fa-f]{1,4}:){7}"), m.rlike(r"(?:^|\.)0[0-9]|^[0-9]{1,2}(?::[0-9]{1,2}){2,4}$"))
    if kind == "card":
        regular = m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ ./_-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$")
        return vote(regular, ~regular)
    if kind == "phone":
        return vote(m.rlike(r"^\+?[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}$"), m.rlike(DATE) | m.rlike(r"(?:[ .()-]+[0-9]+){7}"))
    return vote(m.rlike(r" \p{Lu}[\p{L}'-]+ \p{Lu}"), F.lit(False))


def gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return vote(m.rlike(rf"(?i)\W(?:{ENDINGS})$"), m.rlike(rf"(?i)\.(?:{FILE_ENDINGS})$"))
    if kind == "ip":
        return vote(m.rlike(r"^[1-9][0-9.]+$|^(?i)(?:2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):"), m.rlike(r"^(?:0|10|127|255|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."))
    if kind == "card":
        return F.when(m.rlike(rf"^(?:{ISSUERS})"), YES).otherwise(NO)
    if kind == "phone":
        return vote(m.rlike(rf"^(?:\+|00)(?:{CALLING})"), m.rlike(r"^\+0"))
    return vote(m.rlike(rf" (?:{FIRST_NAMES})\b"), F.lit(False))


def votes(search: Search, m: Column, before: Column, after: Column) -> list[Column]:
    """One vote per labeler: 0 nothing, 1 no, 2 yes."""
    yes, no = BEFORE[search.kind]
    joined = before.rlike(r"[\p{L}0-9_/=#&-]$") | after.rlike(r"^[\p{L}0-9_/=@-]")
    return [
        search.form(m),
        layout(search.kind, m),
        gazetteer(search.kind, m),
        vote(before.rlike(yes), before.rlike(no)),
        vote(after.rlike(AFTER[search.kind]), after.rlike(UNITS)),
        F.when(joined, NO).otherwise(YES),
    ]


def features(search: Search, m: Column, before: Column, after: Column, said: list[Column]) -> list[Column]:
    return [
        said[0] == YES,
        F.length(m) >= 12,
        F.length(m) >= 20,
        m.rlike(r"[ .()/-]"),
        m.rlike(r"\p{L}"),
        ~before.rlike(r"\S$"),
        ~after.rlike(r"^[^\s,.;:!?)]"),
        said[3] == YES,
        said[2] == YES,
        before.rlike(r"[:=] ?$"),
    ]


def code(parts: list[Column], base: int) -> Column:
    return sum((F.lit(base**j) * p.cast("int") for j, p in enumerate(parts)), F.lit(0)).cast("int")


def decoded(number: Column, n: int, base: int) -> list[Column]:
    return [(F.floor(number / base**j) % base).cast("double") for j in range(n)]


def found_in(text: Column, number: int, search: Search) -> Column:
    """The matches of one search as an array of (kind, search, lead, length, base, worth, votes, features).

    ``lead`` is the number of code points since the end of the match before.
    """

    def told(m: Column, gap: Column) -> Column:
        before, after = F.substring(gap["before"], -SEEN_BEFORE, SEEN_BEFORE), F.substring(gap["after"], 1, SEEN_AFTER)
        said = votes(search, m, before, after)
        return F.struct(
            F.lit(KINDS.index(search.kind)).alias("kind"),
            F.lit(number).alias("search"),
            F.length(gap["before"]).alias("lead"),
            F.length(m).alias("length"),
            (search.base(m) if search.base else F.lit(False)).alias("base"),
            (search.worth(m) & (said[-1] != NO)).alias("worth"),
            code(said, 3).alias("votes"),
            code(features(search, m, before, after, said), 2).alias("features"),
        )

    def listed(x: Column) -> Column:
        n = F.size(x["m"])
        gaps = F.zip_with(F.slice(x["gap"], F.lit(1), n), F.slice(x["gap"], F.lit(2), n), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        return F.zip_with(x["m"], gaps, told)

    pattern = F.lit(search.pattern)
    searched = let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, search.pattern, -1).alias("gap")), listed)
    likely = text.contains(search.trigger) if search.trigger in ("@", ":") else text.rlike(search.trigger)
    return F.when(likely, searched)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, found): what the searches match in every text; ``row`` is written with it and then fixed."""
    own = text_of(docs, id_col, text_col)
    per_search = F.array_compact(F.array(*[found_in(F.col("text"), n, s) for n, s in enumerate(SEARCHES)]))
    # a match that is no candidate still counts in ``lead`` of the next one
    return materialise(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.flatten(per_search).alias("found")), "personal-matches")


def vote_counts(found: DataFrame) -> DataFrame:
    """(kind, votes, features, n): at most 3^6 patterns of votes and 2^10 of features per kind."""
    each = found.select(F.explode("found").alias("f")).select("f.*").where("base OR worth")
    return materialise(each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "personal-votes")


def posterior(model: Column, said: list[Column]) -> Column:
    """Probability of personal data given one vote per labeler."""
    odds = F.log(model["prior"] / (1 - model["prior"]))
    for j, v in enumerate(said):
        on, off = F.get(model["on"], F.lit(j)), F.get(model["off"], F.lit(j))
        odds = odds + F.when(v == YES, F.log(on / (1 - off))).when(v == NO, F.log((1 - on) / off)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, model): ``prior``, and per labeler how often a vote is right on personal data (``on``) and off it (``off``)."""
    rows = counts.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n"))
    row = F.struct(F.col("votes"), F.array(*decoded(F.col("votes"), len(LABELERS), 3)).alias("v"), F.col("n"))
    rows = rows.groupBy("kind").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    at = lambda r: [F.get(r["v"], F.lit(j)) for j in range(len(LABELERS))]
    total = lambda a, of: F.aggregate(a, F.lit(0.0), lambda s, r: s + of(r))

    def step(model: Column) -> Column:
        def maximise(weighed: Column) -> Column:
            def right(j: int, says: int, weight: Callable[[Column], Column]) -> Column:
                v = lambda r: F.get(r["v"], F.lit(j))
                hits = total(weighed, lambda r: F.when(v(r) == says, weight(r)).otherwise(0.0))
                cast = total(weighed, lambda r: F.when(v(r) != 0, weight(r)).otherwise(0.0))
                return (hits + RIGHT) / (cast + CAST)

            on, off = lambda r: r["t"], lambda r: r["n"] - r["t"]
            return F.struct(
                ((total(weighed, on) + 1) / (total(weighed, lambda r: r["n"]) + 2)).alias("prior"),
                F.array(*[right(j, YES, on) for j in range(len(LABELERS))]).alias("on"),
                F.array(*[right(j, NO, off) for j in range(len(LABELERS))]).alias("off"),
            )

        weighed = F.transform(F.col("rows"), lambda r: F.struct(r["v"].alias("v"), r["n"].alias("n"), (r["n"] * posterior(model, at(r))).alias("t")))
        return let(weighed, maximise)

    trusted = F.array(*[F.lit(RIGHT / CAST)] * len(LABELERS))
    first = F.struct(F.lit(0.5).alias("prior"), trusted.alias("on"), trusted.alias("off"))
    return rows.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda model, _: step(model)).alias("model"))


def dot(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def classifier(counts: DataFrame, models: DataFrame, steps: int = STEPS) -> DataFrame:
    """(kind, features, score) of every pattern of features that occurs.

    Steps are as long as the bound on the curvature of the logistic loss allows, so the loss falls with every one.
    """
    said = decoded(F.col("votes"), len(LABELERS), 3)
    # one model per kind; posteriors in millionths, so that sums do not depend on their order
    aimed = counts.join(F.broadcast(models), "kind").withColumn("aim", F.round(posterior(F.col("model"), said) * 1e6).cast("long") * F.col("n"))
    rows = aimed.groupBy("kind", "features").agg(F.sum("n").cast("double").alias("n"), (F.sum("aim") / 1e6).alias("t"))
    x = F.array(F.lit(1.0), *decoded(F.col("features"), len(FEATURES), 2))
    rows = rows.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.col("features"), x.alias("x"), F.col("n"), F.col("t")))).alias("rows"))
    size = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["n"])
    zero = F.array(*[F.lit(0.0)] * (len(FEATURES) + 1))

    def step(weights: Column) -> Column:
        pulled = F.transform(F.col("rows"), lambda r: F.struct(r["x"].alias("x"), (r["t"] - r["n"] / (1 + F.exp(-dot(weights, r["x"])))).alias("pull")))
        slope = F.aggregate(pulled, zero, lambda s, r: F.zip_with(s, r["x"], lambda a, b: a + b * r["pull"]))
        rate = 4.0 / (len(FEATURES) + 1) / size
        return F.zip_with(weights, slope, lambda w, g: w + rate * (g - F.lit(RIDGE) * w))

    fitted = rows.select("kind", "rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, lambda w, _: step(w)).alias("weights"))
    each = fitted.select("kind", "weights", F.explode("rows").alias("r"))
    return each.select("kind", F.col("r.features").alias("features"), (1 / (1 + F.exp(-dot(F.col("weights"), F.col("r.x"))))).alias("score"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ``spans``, an array of (kind, start, end, base) by kind, then start."""
    found = matches(docs, id_col, text_col)
    counts = vote_counts(found)
    scores = materialise(classifier(counts, reliabilities(counts)), "personal-scores")
    any_span = F.exists("found", lambda f: f["base"] | f["worth"])
    each = found.where(any_span).select("row", "doc_id", F.posexplode("found").alias("pos", "f")).select("row", "doc_id", "pos", "f.*")
    along = Window.partitionBy("row", "search").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.repartition("row").withColumn("end", F.sum(F.col("lead") + F.col("length")).over(along))
    each = each.withColumn("start", F.col("end") - F.col("length")).where("base OR worth")
    by_place = Window.partitionBy("row").orderBy("start", "pos")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    free = ~(F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False)))
    scored = each.withColumn("free", free).join(small_side(scores), ["kind", "features"], "left")
    kept = scored.withColumn("kept", F.col("base") | (F.col("free") & (F.col("score") >= ADD_AT)))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct(F.col("kind").alias("order"), F.col("start"), F.col("end"), name.alias("kind"), F.col("base"))
    told = kept.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("spans"))
    told = told.select("doc_id", F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base")])).alias("spans"))
    bare = found.where(~any_span).select("doc_id", F.array().cast(told.schema["spans"].dataType).alias("spans"))
    return told.unionByName(bare)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the registered query, from the spans."""
    found = F.col("spans")
    base = F.filter(found, lambda s: s["base"])

    def told(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans(docs).select("doc_id", *map(of, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(found).alias("spans"))
