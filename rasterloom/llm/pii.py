"""PII (3): candidate generators, gradient-boosted trees over format and context, calibrated thresholds. Native SQL only.

Method. Base patterns (e-mail, IP address, payment card, phone) with their checks always give spans. High-recall generators
propose further, overlapping spans: of each run of digits and separators every sub-run of up to GROUPS neighbouring groups
of digits (LEAST_DIGITS to MOST_DIGITS of them), bank account numbers, and spelled-out e-mail addresses. Boosted trees of depth
two score each proposal from its format (digits, groups, separators, Luhn sum, whether its run goes on) and its context
(cue words in the CONTEXT code points before its run, back to the run before); per generator, a threshold calibrated
for PRECISION on families of shapes that the trees were not fitted on selects spans. Proposals that overlap a base
span of their document are dropped, since that span is redacted anyway (most are never made, for the generators read the
text with base spans masked); of selected spans that overlap, the one with the
highest score stays, left to right. There are no labelled spans: the trees are fitted on EXAMPLES rows written by rule
(`examples`), which is a documented, fixed bound; features of examples and of documents come from the same expressions.

Plan. One map over the documents with built-in functions, no shuffle, no Python worker. Positions come from split() and
regexp_extract_all() with one pattern: lengths of pieces and matches add up to offsets in code points. Running sums and
the comparison with base spans (sorted by start, a pass in each direction) are scans over slices of SLICE elements, so
that a text's work grows in line with its length and spans. Cheap guards (a text without digit, '@' or ' dot ' has no
span) keep the patterns off most texts. Patterns are written without nested backtracking: possessive runs that start
where a run starts, so that very long runs cost linear time and no stack. The trees, fitted once in a session, become
one expression of CASE branches.

Defined cases. Null texts count as empty; empty texts have no spans. One row for each input row, repeated ids and null ids
included. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("number", "account", "spelled")
CONTEXT, EXAMPLES, TREES, RATE, PRECISION = 24, 6000, 60, 0.3, 0.98
#: Groups of digits that a proposal has at most, and its digits.
GROUPS, LEAST_DIGITS, MOST_DIGITS = 6, 7, 19
#: Elements that a scan appends one by one; their arrays are then joined.
SLICE = 32

# The base patterns. A leftmost match starts where its run starts or where the last match ended, and possessive runs
# take what greedy ones would, since what follows a run is never part of it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

NUMBER = r"(?<![A-Za-z0-9+])[0-9(][0-9\x20()./-]{6,}+"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
SPELLED = r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?[A-Za-z0-9-]{1,64}+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,12}"

# fixed values: cue words of a proposal's context, by topic
CUES = {
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|dial|ring|sms",
    "identity": "ssn|social|passport|national id|tax id|licen[cs]e no|insurance",
    "bank": "iban|account|bank|transfer|routing|swift",
    "card": "card|visa|mastercard|amex|debit|credit",
    "mail": "mail|contact|write|reach|address",
    "other": "order|invoice|version|page|pages|isbn|year|total|price|serial|part|sku|ref|ticket|section|figure|born in|since|lines?",
}

# fixed values: endings of addresses
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|nl|eu|ch|at|se|pl"

_SPAN = "struct<kind:string,start:bigint,end:bigint,s:string>"
_PROPOSAL = "struct<start:bigint,end:bigint,kind:string,s:string,c:string,on_left:boolean,on_right:boolean>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _scan(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """struct(state, out) after step(state, item) -> (state, output of type `kind`) over all items; null for no items."""

    def over(own: Column) -> Column:
        def places(k: Column) -> Column:
            return F.sequence(k * SLICE, F.least(k * SLICE + SLICE, F.size(own)) - 1)

        def inner(acc: Column, i: Column) -> Column:
            state, out = step(acc["state"], F.get(own, i))
            return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

        def ahead(acc: Column, k: Column) -> Column:
            after = F.aggregate(places(k), acc["state"], lambda state, i: step(state, F.get(own, i))[0])
            return _let(after, lambda state: F.struct(state.alias("state"), F.concat(acc["all"], F.array(state)).alias("all")))

        def outputs(k: Column, state: Column) -> Column:
            return F.aggregate(places(k), F.struct(state.alias("state"), _none(kind).alias("out")), inner, lambda a: a["out"])

        slices = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / SLICE).cast("int"))
        # the states that slices begin with, then each slice's outputs: an accumulator is copied in each step, and stays small
        states = F.aggregate(slices, F.struct(zero.alias("state"), F.array(zero).alias("all")), ahead)
        whole = _let(states, lambda s: F.struct(s["state"].alias("state"), F.flatten(F.transform(slices, lambda k: outputs(k, F.get(s["all"], k)))).alias("out")))
        return F.when(F.size(own) > 0, whole)

    return _let(items, over)


def _scanned(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    return F.coalesce(_scan(items, zero, kind, step)["out"], _none(kind))


def _pieces(text: Column, pattern: str) -> Column:
    """(before, hit) of each match of a pattern; what follows the last one is left out."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    return _let(hits, lambda h: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)).alias("before"), h.alias("hit")))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as spans, leftmost and not overlapping, with the end `c` of the text before each."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + F.char_length(x["before"])
        b = a + F.char_length(x["hit"])
        return b, F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["hit"].alias("s"), F.lower(F.substring(x["before"], F.lit(-CONTEXT), F.lit(CONTEXT))).alias("c"))

    return _scanned(_pieces(text, pattern), F.lit(0).cast("long"), _FOUND, step)


_FOUND = "struct<kind:string,start:bigint,end:bigint,s:string,c:string>"


def _spans(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))


def _if(guard: Column, value: Column, kind: str = _SPAN) -> Column:
    return F.when(guard, value).otherwise(_none(kind))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.pmod(c.try_cast("int") * 2, F.lit(10)) + F.floor(c.try_cast("int") * 2 / 10).cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_ip(s: Column) -> Column:
    return s.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")


def is_card(s: Column) -> Column:
    return F.char_length(_digits(s)).between(16, 19) & luhn(_digits(s))


def is_phone(s: Column) -> Column:
    return F.char_length(_digits(s)).between(8, 15)


def _digits_of_letters(s: Column) -> Column:
    """An account number with its first four characters at the end and 10 to 35 in place of A to Z."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4)), "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def remainder_97(digits: Column) -> Column:
    """A string of digits, modulo 97."""
    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind and start."""
    digit = text.rlike("[0-9]")
    email = _if(F.contains(text, F.lit("@")), _spans(_found(text, EMAIL, "email")))
    ip = F.filter(_if(digit & F.contains(text, F.lit(".")), _spans(_found(text, IP, "ip"))), lambda x: is_ip(x["s"]))
    card = F.filter(_if(digit, _spans(_found(text, CARD, "card"))), lambda x: is_card(x["s"]))
    phone = F.filter(_if(digit & F.contains(text, F.lit("+")), _spans(_found(text, PHONE, "phone"))), lambda x: is_phone(x["s"]))
    return F.concat(email, ip, card, phone)


def _sub_runs(run: Column) -> Column:
    """Proposals of one run: its sub-runs of neighbouring groups of digits that have the right number of digits."""
    group = "struct<at:bigint,sep:string,g:string>"

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + F.char_length(x["before"])
        return a + F.char_length(x["hit"]), F.struct(a.alias("at"), x["before"].alias("sep"), x["hit"].alias("g"))

    def of(groups: Column) -> Column:
        n = F.size(groups)

        def sub(k: int, first: Column) -> Column:
            # the first group, and separators and groups that follow
            own = F.slice(groups, first + 1, F.lit(k))
            head = F.get(own, F.lit(0))
            s = F.concat(head["g"], F.array_join(F.transform(F.slice(own, F.lit(2), F.lit(k)), lambda x: F.concat(x["sep"], x["g"])), ""))
            opened = head["sep"].endswith("(") & F.contains(s, F.lit(")"))
            s = F.concat(F.when(opened, F.lit("(")).otherwise(F.lit("")), s)
            start = run["start"] + head["at"] - opened.cast("long")
            return F.struct(start.alias("start"), (start + F.char_length(s)).alias("end"), F.lit("number").alias("kind"), s.alias("s"), run["c"].alias("c"), (first > 0).alias("on_left"), (first + k < n).alias("on_right"))

        def of_length(k: int) -> Column:
            return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda first: sub(k, first))).otherwise(_none(_PROPOSAL))

        lengths = [of_length(k) for k in range(1, GROUPS + 1)]
        return F.filter(F.concat(*lengths), lambda x: F.char_length(_digits(x["s"])).between(LEAST_DIGITS, MOST_DIGITS))

    return _let(_scanned(_pieces(run["s"], "[0-9]++"), F.lit(0).cast("long"), group, place), of)


def masked(text: Column) -> Column:
    """The text with base matches as long runs of a sign that no generator takes; spans that overlap others may stay in part."""

    def without(text: Column, pattern: str, good: Callable[[Column], Column]) -> Column:
        def of(pieces: Column) -> Column:
            part = F.transform(pieces, lambda x: F.concat(x["before"], F.when(good(x["hit"]), F.repeat(F.lit("\u0001"), F.char_length(x["hit"]))).otherwise(x["hit"])))
            return F.when(F.size(pieces) > 0, F.concat(F.array_join(part, ""), F.element_at(F.split(text, pattern, -1), -1))).otherwise(text)

        return _let(_pieces(text, pattern), of)

    def once(pattern: str, good: Callable[[Column], Column], text: Column) -> Column:
        return _let(text, lambda own: without(own, pattern, good))

    return once(PHONE, is_phone, once(CARD, is_card, once(IP, is_ip, once(EMAIL, lambda s: F.lit(True), text))))


def proposals(text: Column) -> Column:
    """Overlapping spans of the generators, with their contexts."""
    number = _if(text.rlike("[0-9]"), F.flatten(F.transform(_found(text, NUMBER, "number"), _sub_runs)), _PROPOSAL)

    def whole(found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s"), x["c"].alias("c"), F.lit(False).alias("on_left"), F.lit(False).alias("on_right")))

    account = _if(text.rlike("[A-Z]{2}[0-9]{2}"), whole(_found(text, ACCOUNT, "account")), _PROPOSAL)
    spelled = _if(text.rlike(r"[\x20(\[]dot[\x20)\]]"), whole(_found(text, SPELLED, "spelled")), _PROPOSAL)
    return F.concat(number, account, spelled)


def free_of(proposed: Column, base: Column) -> Column:
    """The proposals that overlap no base span: one scan for base spans that begin before, one for those that begin later."""
    event = "struct<start:bigint,end:bigint,asked:boolean,p:{0},hit:boolean>".format(_PROPOSAL)

    def events(spans: Column, asked: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(asked).alias("asked"), (x if asked else F.lit(None).cast(_PROPOSAL)).alias("p"), F.lit(False).alias("hit")))

    def marked(x: Column, hit: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["asked"].alias("asked"), x["p"].alias("p"), (x["hit"] | hit).alias("hit"))

    def ahead(last: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["asked"], last).otherwise(F.greatest(last, x["end"])), marked(x, last > x["start"])

    def back(first: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["asked"], first).otherwise(F.least(first, x["start"])), marked(x, first < x["end"])

    ordered = F.sort_array(F.concat(events(base, False), events(proposed, True)))
    once = _scanned(ordered, F.lit(-1).cast("long"), event, ahead)
    twice = _scanned(F.reverse(once), F.lit(2**62).cast("long"), event, back)
    kept = F.transform(F.filter(F.reverse(twice), lambda x: x["asked"] & ~x["hit"]), lambda x: x["p"])
    return F.when((F.size(base) > 0) & (F.size(proposed) > 0), kept).otherwise(F.sort_array(proposed))


FEATURES = ("digits", "length", "groups", "spaces", "dashes", "dots", "slashes", "brackets", "longest", "shortest", "first", "luhn", "date", "account", "spelled", "signs", "checked", "domain", "on_left", "on_right", "alike", "no_cue", *(f"cue_{c}" for c in CUES))


def features(span: Column) -> Column:
    """The numbers that the trees see of a proposal: an array of doubles in the order of FEATURES."""
    s = span["s"]
    digits = _digits(s)
    sizes = F.transform(F.regexp_extract_all(s, F.lit("[0-9]++"), 0), lambda g: F.char_length(g))
    separators = F.filter(F.split(s, "[0-9]++", -1), lambda x: x != "")

    def times(sign: str) -> Column:
        return F.char_length(s) - F.char_length(F.replace(s, F.lit(sign), F.lit("")))

    cues = {c: span["c"].rlike(rf"(?<![a-z])(?:{words})(?![a-z])") for c, words in CUES.items()}
    any_cue = F.lit(False)
    for found in cues.values():
        any_cue = any_cue | found
    values = {
        "digits": F.char_length(digits),
        "length": F.char_length(s),
        "groups": F.size(sizes),
        "spaces": times(" "),
        "dashes": times("-"),
        "dots": times("."),
        "slashes": times("/"),
        "brackets": times("("),
        "longest": F.array_max(sizes),
        "shortest": F.array_min(sizes),
        "first": F.get(sizes, F.lit(0)),
        "luhn": luhn(digits).cast("int"),
        "date": s.rlike(r"^(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2})$").cast("int"),
        "account": (span["kind"] == "account").cast("int"),
        "spelled": (span["kind"] == "spelled").cast("int"),
        "signs": F.size(F.regexp_extract_all(s, F.lit(r"[(\[](?:at|dot)[)\]]"), 0)),
        "checked": _let(_digits_of_letters(s), lambda d: F.when(span["kind"] == "account", remainder_97(d) == 1)).cast("int"),
        "domain": s.rlike(rf"(?:{DOMAINS})$").cast("int"),
        "on_left": span["on_left"].cast("int"),
        "on_right": span["on_right"].cast("int"),
        "alike": F.size(F.array_distinct(separators)),
        "no_cue": (~any_cue).cast("int"),
    } | {f"cue_{c}": found.cast("int") for c, found in cues.items()}
    return F.array(*(F.coalesce(values[f].cast("double"), F.lit(0.0)) for f in FEATURES))


def shapes() -> list[tuple[int, int, str, str]]:
    """(family, personal or not, cue, shape) of the examples; '#' is a digit, '@' a capital letter, '|' parts two numbers.

    A family is a way to write a number, whatever stands before it.
    """
    # fixed values: how groups of digits are written, and what stands before them
    phones = [(3, 3, 4), (2, 2, 2, 2, 2), (4, 6), (3, 4, 4), (5, 6), (4, 3, 4), (3, 7), (2, 4, 4), (3, 2, 2, 3), (4, 4, 3)]
    phone_cues = ("phone: ", "call me on ", "tel. ", "mobile ", "dial ", "cell ", "fax ", "sms to ")
    other_cues = ("order ", "invoice ", "page ", "version ", "total ", "ref ", "serial ", "sku ", "ticket ", "part ")
    identities = ["###-##-####", "### ## ####", "#########", "## ### ###", "########", "#### #### ####"]
    identity_cues = ("ssn ", "passport ", "social security ", "tax id ", "national id ")
    accounts = ["@@!! #### #### #### ####", "@@!!@@@@##############", "@@!! #### #### #### #### ##", "@@!! #### #### #### #### #### ##", "@@!!################", "@@!! #### #### #### #### ###"]  # '!!': check digits
    bank_cues = ("iban ", "account ", "bank account ", "transfer to ")
    bank_numbers = ["########-##", "##########", "######## ####", "###-######-#"]
    spelled = ["john (at) mail (dot) com", "a.smith [at] corp [dot] org", "anna at mail dot de", "jo (at) site (dot) net", "m_k [at] web.host [dot] io", "li (at) uni dot edu", "eva [at] firma dot de", "x99 at box dot fr", "tom at work dot com"]
    plain = ["20##-0#-1#", "1#/0#/19##", "#.#.##.####", "978-#-##-######-#", "############", "################", "### ### ###", "# # # # # # # # #", "#### #### #### ####", "####.####.####", "##.##.20##", "###-####", "#######", "#,### ####"]
    not_mail = ["him at home dot matrix", "it at one dot here", "up at six dot painting", "look at red dot below", "met at noon dot and", "sit at any dot or"]
    not_account = ["@@## #### #### ####", "@@##@@@@####@@@@", "@@## @@## @@## @@## ##", "@@## #### #### #### ####", "@@##@@##@@##@@##", "@@##############"]
    out, family = [], 0

    def add(y: int, cues: tuple[str, ...], shape: str) -> None:
        out.extend((family, y, cue, shape) for cue in cues)

    for groups in phones:
        for sign in (" ", "-", ".", "/"):
            family += 1
            for shape in (sign.join("#" * g for g in groups), "(" + "#" * groups[0] + ") " + sign.join("#" * g for g in groups[1:])):
                add(1, phone_cues, shape)
                add(0, other_cues, shape)
            both = sign.join("#" * g for g in groups)
            add(1, phone_cues[:3], f"{both} / |{both}")
        family += 1
        add(1, ("",), "(" + "#" * groups[0] + ") " + "-".join("#" * g for g in groups[1:]))
    for y, cues, some in ((1, identity_cues, identities), (0, other_cues, identities), (1, ("", *bank_cues), accounts), (1, bank_cues, bank_numbers), (0, other_cues, bank_numbers), (1, ("", "mail me: ", "contact ", "write to "), spelled), (0, ("", *other_cues), plain), (0, ("", "we met ", "look "), not_mail), (0, ("", *other_cues), not_account)):
        for shape in some:
            family += 1
            add(y, cues, shape)
    return out


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(id, family, text, y, at): texts with one planted number each (or two), written by rule; y says whether it is personal, at where its spans lie."""
    of = shapes()
    rows = []
    for i in range(n):
        rng = np.random.default_rng(i)
        family, y, cue, shape = of[int(rng.integers(len(of)))]
        lead = ("", "the text of it, ", "As said before. ", "Et puis, ")[int(rng.integers(4))]
        fill = "".join(str(rng.integers(10)) if c == "#" else chr(65 + int(rng.integers(26))) if c == "@" else c for c in shape)
        if "!!" in fill:  # as in account numbers: check digits make the remainder 1
            plain = fill.replace(" ", "")
            number = int("".join(c if c.isdigit() else str(ord(c) - 55) for c in plain[4:] + plain[:2] + "00"))
            fill = fill.replace("!!", f"{98 - number % 97:02d}")
        at, spans = len(lead + cue), []
        for part in fill.split("|"):
            own = part.removesuffix(" / ")
            spans.append((at, at + len(own)))
            at += len(part)
        rows.append((i, family, lead + cue + fill.replace("|", "") + " and so on.", y, spans))
    return spark.createDataFrame(rows, "id long, family int, text string, y int, at array<struct<start:long,end:long>>")


def scored_examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(id, family, kind, start, end, x, y): the proposals of the examples that overlap no base span; y of 1 for personal ones."""
    seen = examples(spark, n).withColumn("p", F.explode(free_of(proposals(F.col("text")), base_spans(F.col("text")))))
    exact = F.exists("at", lambda a: (a["start"] == F.col("p.start")) & (a["end"] == F.col("p.end")))
    return seen.select("id", "family", "p.kind", "p.start", "p.end", features(F.col("p")).alias("x"), (exact & (F.col("y") == 1)).cast("int").alias("y"))


class Trees:
    """Boosted trees of depth two for the logistic loss, fitted on a bounded sample on the driver."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.trees: list[tuple] = []
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        self.start = math.log(share / (1 - share))
        cuts = [(f, c) for f in range(x.shape[1]) for c in _between(np.unique(x[:, f]))]
        below = np.stack([x[:, f] <= c for f, c in cuts], axis=1).astype(np.float64) if cuts else np.zeros((len(y), 0))
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(cuts, below, y - p, p * (1 - p), np.ones(len(y)), 2)
            self.trees.append(tree)
            score += values(tree, x)

    def _grow(self, cuts: list, below: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        """A leaf (value,), or (feature, cut, tree at or below, tree above) for the rows of weight 1."""
        g, h, n = float(grad @ rows), float(hess @ rows), float(rows.sum())
        leaf = (RATE * g / (h + 1.0),)
        if not depth or n < 8 or not cuts:
            return leaf
        gl, hl, nl = (grad * rows) @ below, (hess * rows) @ below, rows @ below
        gain = np.where((nl >= 4) & (nl <= n - 4), gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
        best = int(np.argmax(np.round(gain, 9)))
        if gain[best] <= 1e-6:
            return leaf
        return *cuts[best], self._grow(cuts, below, grad, hess, rows * below[:, best], depth - 1), self._grow(cuts, below, grad, hess, rows * (1 - below[:, best]), depth - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(values(t, x) for t in self.trees)

    def column(self, x: Column) -> Column:
        """The same sum as an expression over an array of features."""

        def branch(tree: tuple) -> Column:
            if len(tree) == 1:
                return F.lit(float(tree[0]))
            f, c, left, right = tree
            return F.when(F.get(x, F.lit(f)) <= float(c), branch(left)).otherwise(branch(right))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + branch(tree)
        return total


def values(tree: tuple, x: np.ndarray) -> np.ndarray:
    """A tree's value for each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], values(tree[2], x), values(tree[3], x))


def _between(found: np.ndarray) -> list[float]:
    """At most a dozen cuts or so between distinct values."""
    cuts = ((found[1:] + found[:-1]) / 2).tolist()
    return cuts[:: max(1, len(cuts) // 12)]


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The least score at and above which PRECISION of the examples are personal; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # of equal scores all are selected
    last = np.append(score[order][1:] != score[order][:-1], True)[: len(y)]
    good = np.flatnonzero((right >= PRECISION) & last)
    return float(score[order][good[-1]]) if len(good) else math.inf


_FITTED: dict[str, tuple[Trees, dict[str, float]]] = {}


def fit(spark: SparkSession) -> tuple[Trees, dict[str, float]]:
    """The trees, and the threshold of each generator; every third family calibrates. Kept for the session."""
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        rows = scored_examples(spark).collect()
        x, y = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)
        kind, aside = np.array([r["kind"] for r in rows]), np.array([r["family"] for r in rows]) % 3 == 0
        trees = Trees(x[~aside], y[~aside])
        score = trees.score(x)
        _FITTED[app] = trees, {k: threshold(score[aside & (kind == k)], y[aside & (kind == k)]) for k in ADDED_KINDS}
    return _FITTED[app]


def best_of(scored: Column) -> Column:
    """Of selected spans, sorted by start, those that stay: a span gives way to one that overlaps it with a higher score."""
    kind = "struct<start:bigint,end:bigint,kind:string,s:string,score:double>"
    nothing = F.lit(None).cast(kind)

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        over = held.isNotNull() & (x["start"] < held["end"])
        return F.when(over & (x["score"] <= held["score"]), held).otherwise(x), F.when(over, nothing).otherwise(held)

    done = _scan(scored, nothing, kind, step)
    return F.filter(F.concat(F.coalesce(done["out"], _none(kind)), F.array(done["state"])), lambda x: x.isNotNull())


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): base spans and selected proposals, by kind in order and start; positions in code points."""
    trees, thresholds = fit(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    any_ = text.rlike(r"[0-9@]|[\x20(\[]dot[\x20)\]]")
    found = rows.withColumn("base", _if(any_, base_spans(text)))
    # what lies in base spans isn't proposed; the rest is compared with them below
    found = found.withColumn("rest", F.when(F.size("base") > 0, masked(text)).otherwise(text))
    found = found.withColumn("more", _if(any_, proposals(F.col("rest")), _PROPOSAL))

    def scored(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s"), _let(features(x), trees.column).alias("score"))

    def selected(x: Column) -> Column:
        least = F.lit(0.0)
        for kind in ADDED_KINDS:
            least = F.when(x["kind"] == kind, F.lit(float(min(thresholds[kind], 1e9)))).otherwise(least)
        return x["score"] >= least

    seen = found.withColumn("more", F.when(F.size("more") > 0, F.filter(F.transform(free_of(F.col("more"), F.col("base")), scored), selected)))
    kept = seen.withColumn("more", F.when(F.size("more") > 0, best_of(F.col("more"))))

    def of_kind(kind: str) -> Column:
        return F.filter("more", lambda x: x["kind"] == kind)

    ordered = F.concat(*map(of_kind, ADDED_KINDS))
    return kept.select("id", "text", F.concat("base", F.coalesce(_spans(ordered), _none(_SPAN))).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): texts with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    ordered = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        over = x["start"] < state["at"]
        mark = F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["kind"].alias("kind"))
        return F.struct(F.greatest(state["at"], F.when(over, F.lit(0)).otherwise(-x["back"])).alias("at")), F.when(~over, mark)

    kept = F.filter(_scanned(ordered, zero, "struct<start:bigint,end:bigint,kind:string>", step), lambda x: x.isNotNull())
    found = pii_spans(docs, id_col, text_col).withColumn("kept", kept)
    # code points as an array: substring() would walk the text anew for every span
    chars = F.when(F.size("kept") > 0, F.split("text", ""))
    gaps = F.transform(F.sequence(F.lit(0), F.size("kept")), lambda i: F.struct(F.when(i > 0, F.get("kept", i - 1)["end"]).otherwise(F.lit(0).cast("long")).alias("a"), F.coalesce(F.get("kept", i)["start"], F.char_length("text").cast("long")).alias("b"), F.get("kept", i)["kind"].alias("kind")))
    part = _let(chars, lambda own: F.transform(gaps, lambda g: F.concat(F.array_join(F.slice(own, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")), ""), F.coalesce(F.concat(F.lit("["), g["kind"], F.lit("]")), F.lit("")))))
    return found.select("id", F.when(F.size("kept") > 0, F.array_join(part, "")).otherwise(F.col("text")).alias("text"))
