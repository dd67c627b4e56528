"""Personal data by weak supervision.

One scan finds candidate spans: every match of the four base patterns, valid
or not, and matches of looser ones (national phone numbers, addresses with
"(at)"), of long strings with digits, which may be secrets, and of account and
social security numbers. Labelers vote yes, no or nothing on each: the strict pattern check,
the candidate's shape, small gazetteers, the words before it, and what it
touches. Expectation-maximisation over the counts of equal ballots, at most
243 for each kind, estimates how reliable each labeler is. The resulting
probabilities train the final classifier, naive Bayes over categorical span
features; it adds the candidates that it holds likelier personal than not.
Base spans always stay.

Edge cases: a null text counts as empty; no candidate at all leaves the prior
model, which adds nothing; added spans never overlap base spans or earlier
added ones; rows that share an id are judged one by one; offsets are code
points; an empty table gives an empty table. Only the named columns are
read, so further columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, table

KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: The base patterns. Possessive repeats and the look-behinds keep the search
#: linear; they match what the plain patterns match, leftmost first.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){11,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Characters of keys and tokens in common encodings.
SECRET = "A-Za-z0-9+/_-"
LOOSE = {
    "email": f"(?<![{LOCAL}])[{LOCAL}]++\\x20?[(\\[]at[)\\]]\\x20?[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "phone": "(?<![0-9+(.-])(?<!\\+[0-9]{1,3}\\x20)\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": f"(?<![{SECRET}])(?=[A-Za-z+/_-]*+[0-9])(?=[{SECRET}]{{16}})[{SECRET}]++={{0,2}}",
    "id": "(?<![A-Za-z0-9-])(?:[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])",
}
#: A text without this character can't match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "info", "biz")
CARD_HEADS = ("4", "51", "52", "53", "54", "55", "34", "37", "60", "65", "35", "36", "38")
HINTS = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "\\bip\\b|host|server|address|adresse|node|gateway|login",
    "card": "card|visa|credit|debit|karte|tarjeta|carte|pay|iban",
    "secret": "token|key|secret|passw|pwd|auth|bearer|credential|api",
    "id": "iban|\\bssn|social|passport|account|konto|cuenta|compte|tax|steuer|\\bid\\b",
    "phone": "phone|call|tel\\b|tel:|mobile|fax|cell|anruf|llamar|appel",
}
AGAINST = "order|invoice|version|serial|isbn|token|hash|build|ticket|article|ref\\b"
AGAINST_SECRET = "hash|\\bsha|md5|checksum|commit|digest|build|version|isbn|uuid|etag|https?:"
SECRET_HEADS = ("sk", "pk", "gh", "AKIA", "xox", "eyJ", "AIza", "glpat")
ROUNDS = 30


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(items: str, state: dict[str, str], kind: str, step: str) -> str:
    """SQL for what folding an array puts out.

    ``state`` has the names and first values of what is carried. ``step``
    makes a struct (the new state, and out, an array of ``kind``) of a, the
    state, and x, an item. Items are folded in runs of about the square root
    of their number, so that no array grows one by one over all of them.
    """
    none = f"cast(array() as array<{kind}>)"
    zero, old, new = (", ".join(f"'{n}', {v or f'{x}.{n}'}" for n, v in s.items()) for s, x in ((state, ""), (dict.fromkeys(state), "a"), (dict.fromkeys(state), "r")))
    run = f"aggregate(c, named_struct({old}, 'out', {none}), (a, x) -> {_let('r', step, f'named_struct({new}, {chr(39)}out{chr(39)}, if(size(r.out) = 0, a.out, concat(a.out, r.out)))')})"
    width = "cast(ceil(sqrt(greatest(size(l), 1))) as int)"
    runs = _let("l", items, f"transform(sequence(0, greatest(size(l) - 1, 0) div {width}), i -> slice(l, i * {width} + 1, {width}))")
    return f"""aggregate({runs}, named_struct({zero}, 'out', cast(array() as array<array<{kind}>>)),
      (a, c) -> {_let('r', run, f"named_struct({new}, 'out', concat(a.out, array(r.out)))")}, a -> flatten(a.out))"""


def _spans(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, m, before, after>>: code-point spans of a pattern's matches, 24 code points before and one after.

    The pieces between matches and the matches in turn give the offsets and
    the surroundings, so that the text is read once for all matches.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    kind = "struct<s:int,e:int,m:string,before:string,after:string>"
    items = _let("ms", f"regexp_extract_all({text}, '{p}', 0)", _let("gaps", f"split({text}, '{p}', -1)", "transform(gaps, (gap, i) -> named_struct('m', get(ms, i), 'gap', gap, 'after', substring(concat(coalesce(get(gaps, i + 1), ''), coalesce(get(ms, i + 1), '')), 1, 1)))"))
    step = f"""if(x.m is null, named_struct('at', a.at, 'tail', a.tail, 'out', cast(array() as array<{kind}>)),
      named_struct('at', a.at + length(x.gap) + length(x.m), 'tail', right(concat(a.tail, x.gap, x.m), 24),
        'out', array(named_struct('s', a.at + length(x.gap), 'e', a.at + length(x.gap) + length(x.m), 'm', x.m, 'before', right(concat(a.tail, x.gap), 24), 'after', x.after))))"""
    return _fold(items, {"at": "0", "tail": "''"}, kind, step)


def _free() -> str:
    """SQL for the structs (s, kind, e) of column more that overlap none of column base and, in order of their starts, none taken before."""
    place, full = "struct<s:int,kind:int,e:int>", "struct<s:int,kind:int,e:int,own:int,next:int>"
    both = "array_sort(concat(transform(base, b -> named_struct('s', b.s, 'kind', b.kind, 'e', b.e, 'own', 0)), transform(more, b -> named_struct('s', b.s, 'kind', b.kind, 'e', b.e, 'own', 1))))"
    # From the last to the first: where the next base span begins, as a negative number (0: nowhere).
    back = _fold(f"reverse({both})", {"next": "0"}, full, "named_struct('next', if(x.own = 0, x.s - 2147483647, a.next), 'out', array(named_struct('s', x.s, 'kind', x.kind, 'e', x.e, 'own', x.own, 'next', a.next)))")
    # From the first to the last: what ends before this span begins.
    keep = "x.own = 1 and a.held <= x.s and (a.taken <= x.s) and x.next + 2147483647 >= x.e"
    step = f"""named_struct('held', if(x.own = 0, greatest(a.held, x.e), a.held), 'taken', if({keep}, x.e, a.taken),
      'out', if({keep}, array(named_struct('s', x.s, 'kind', x.kind, 'e', x.e)), cast(array() as array<{place}>)))"""
    return f"if(size(more) = 0, cast(array() as array<{place}>), {_fold(f'reverse({back})', {'held': '0', 'taken': '0'}, place, step)})"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """SQL: the digits of ``d`` pass the checksum."""
    twice = f"(cast(substring({d}, length({d}) - i + 1, 1) as int) * (2 - i % 2))"
    return f"(aggregate(transform(sequence(1, length({d})), i -> cast({twice} div 10 as int) + {twice} % 10), 0, (a, x) -> a + x) % 10 = 0)"


VALID = {
    "email": lambda m: "true",
    "ip": lambda m: f"forall(split({m}, '[.]'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{{1,2}})$')",
    "card": lambda m: f"(length({_digits(m)}) <= 19 and {_luhn(_digits(m))})",
    "phone": lambda m: f"length({_digits(m)}) between 9 and 15",
}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): all candidate spans of a document as array of structs.

    Fields: s, e, kind (place in KINDS), base (a valid base match), m (the
    match), before (24 code points, lower case) and after (one).
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = []
    for loose, patterns in ((False, BASE), (True, LOOSE)):
        for kind, pattern in patterns.items():
            need = "at" if loose and kind == "email" else "" if loose else NEEDS.get(kind, "")
            valid = "false" if loose else VALID[kind]("x.m")
            got = f"""transform({_spans('text', pattern)}, x -> named_struct('s', x.s, 'e', x.e, 'kind', {KINDS.index(kind)}, 'base', {valid}, 'm', x.m, 'before', lower(x.before), 'after', x.after))"""
            nothing = "cast(array() as array<struct<s:int,e:int,kind:int,base:boolean,m:string,before:string,after:string>>)"
            parts.append(f"if(contains(text, '{need}'), {got}, {nothing})" if need else got)
    return src.select("id", F.expr(f"concat({', '.join(parts)})").alias("found"))


def account_number(m: Column) -> Column:
    """The number leaves 1 by 97 after its first four characters move to the end and letters count from 10."""
    chars = F.regexp_replace(m, " ", "")
    moved = F.split(F.concat(F.substring(chars, 5, 40), F.substring(chars, 1, 4)), "")

    def take(rest: Column, x: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x) - 1
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(moved, lambda x: x != ""), F.lit(0), take) == 1


def hinted(c: Column) -> Column:
    """1, -1 or 0: the words before a candidate speak for its kind, against it, or neither."""
    kind, secret = c["kind"], c["kind"] == KINDS.index("secret")
    hint = F.lit(False)
    for i, k in enumerate(KINDS):
        hint = hint | ((kind == i) & c["before"].rlike(HINTS[k]))
    against = F.when(secret, c["before"].rlike(AGAINST_SECRET)).otherwise(c["before"].rlike(AGAINST))
    # What is named a hash is none of the secrets, whatever else is near.
    return F.when(secret & against, -1).when(hint, 1).when(against, -1).otherwise(0)


def char_classes(m: Column) -> Column:
    """How many of small letters, capitals, digits and other marks a string has."""
    return sum((m.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))


def checks(c: Column) -> Column:
    """1, -1 or 0: a candidate passes its kind's rule or checksum, fails it, or there is none."""
    kind, m = c["kind"], c["m"]
    number = F.when(m.rlike("^[0-9]"), ~m.rlike("^(000|666|9)|-00-|-0000$")).otherwise(account_number(m))
    own = F.when(kind == KINDS.index("id"), F.when(number, 1).otherwise(-1)).when(kind.isin(KINDS.index("email"), KINDS.index("secret")), 0)
    return F.when(c["base"], 1).otherwise(own.otherwise(-1))


def ballot(c: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1, 0 or -1 each."""
    kind, m = c["kind"], c["m"]

    def by_kind(*values):
        return F.get(F.array(*values), kind)

    def yes_no(cond):
        return F.when(cond, 1).otherwise(-1)

    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    shape = by_kind(
        yes_no(m.rlike(r"^[^.].*[^.]@|at[)\]]")),
        yes_no(~m.rlike(r"(^|\.)0[0-9]")),
        yes_no(n.isin(13, 15, 16)),
        yes_no(m.rlike(r"^\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,4}$")),
        yes_no(m.rlike("^([0-9a-f]{2}){14,}$|^([0-9A-F]{2}){14,}$") | ((char_classes(m) >= 3) & (n * 12 >= F.length(m)) & ~m.rlike("/.*/"))),
        F.lit(0),
    )
    starts = lambda heads, x=digits: F.exists(F.array(*[F.lit(h) for h in heads]), lambda h: F.startswith(x, h))
    gazetteer = by_kind(
        F.when(F.lower(F.element_at(F.split(m, "[.]"), -1)).isin(*TOP_DOMAINS), 1).otherwise(0),
        F.when(m.rlike(r"^(0|127|255)\."), -1).otherwise(F.lit(0)),
        yes_no(starts(CARD_HEADS)),
        F.when(starts(("1", "33", "34", "44", "49")) & m.startswith("+"), 1).otherwise(0),
        F.when(starts(SECRET_HEADS, m), 1).otherwise(0),
        F.lit(0),
    )
    assigned = c["before"].rlike("""[=:] ?["']?$""")
    touches = F.when(kind == KINDS.index("secret"), F.when(assigned, 1).when(c["before"].rlike(r"[\p{L}0-9.#@]$") | c["after"].rlike(r"[\p{L}0-9.@]"), -1).otherwise(F.lit(0)))
    touches = touches.when((c["before"] != "") & c["before"].rlike(r"[\p{L}0-9_=#/\"']$") | c["after"].rlike(r"[\p{L}0-9_=#/\"']"), -1).otherwise(F.when(kind == KINDS.index("id"), 0).otherwise(1))
    return [checks(c), shape, gazetteer, hinted(c), touches]


FEATURES = ("kind", "digits", "length", "marks", "head", "before", "checks", "context", "classes", "assigned", "after")


def features(c: Column) -> list[Column]:
    """Categories of a candidate for the classifier, as in FEATURES; few, whatever the text."""
    k = F.concat(c["kind"].cast("string"), F.lit("|"))
    n = F.length(F.regexp_replace(c["m"], "[^0-9]", ""))
    return [
        F.concat(F.lit("kind|"), k),
        F.concat(F.lit("digits|"), k, F.least(n, F.lit(20)).cast("string")),
        F.concat(F.lit("length|"), k, F.least(F.floor(F.length(c["m"]) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("marks|"), k, F.substring(F.regexp_replace(F.regexp_replace(c["m"], r"[A-Za-z0-9]+", ""), r"(.)\1+", "$1"), 1, 3)),
        F.concat(F.lit("head|"), k, F.regexp_extract(c["m"], "^[^0-9]?([0-9])", 1)),
        F.concat(F.lit("before|"), k, F.when(c["before"] == "", "none").when(c["before"].rlike(r"\s$"), "space").when(c["before"].rlike(r"[\p{L}0-9]$"), "word").otherwise("mark")),
        F.concat(F.lit("checks|"), k, checks(c).cast("string")),
        F.concat(F.lit("context|"), k, hinted(c).cast("string")),
        F.concat(F.lit("classes|"), k, char_classes(c["m"]).cast("string")),
        F.concat(F.lit("assigned|"), k, c["before"].rlike("""[=:] ?["']?$""").cast("string")),
        F.concat(F.lit("after|"), k, F.when(c["after"] == "", "none").when(c["after"].rlike(r"\s"), "space").when(c["after"].rlike(r"[\p{L}0-9]"), "word").otherwise("mark")),
    ]


def reliabilities(ballots: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Probability that a candidate with a ballot is personal data, by expectation-maximisation.

    ``ballots`` are distinct votes with their counts: 243 at most. Votes are
    taken as independent given the truth; a labeler's reliability is how
    often it says each of its three answers for either truth, with one
    imagined vote of each kind so that no answer is impossible.
    """
    p = {b: 0.9 if sum(b) > 0 else 0.1 for b, _ in ballots}
    for _ in range(ROUNDS if ballots else 0):
        n = sum(c for _, c in ballots)
        mass = {1: 1.0 + sum(c * p[b] for b, c in ballots), 0: 1.0 + sum(c * (1 - p[b]) for b, c in ballots)}
        say = {}
        for i in range(len(ballots[0][0])):
            for v in (-1, 0, 1):
                yes = sum(c * p[b] for b, c in ballots if b[i] == v)
                no = sum(c * (1 - p[b]) for b, c in ballots if b[i] == v)
                # A labeler is held to be right a little more often than not.
                say[i, v, 1], say[i, v, 0] = (yes + 1 + v * 0.5) / (mass[1] + 2), (no + 1 - v * 0.5) / (mass[0] + 2)
        odds = {b: math.log(mass[1] / mass[0]) + sum(math.log(say[i, v, 1] / say[i, v, 0]) for i, v in enumerate(b)) for b, _ in ballots}
        new = {b: 1 / (1 + math.exp(-max(min(x, 40), -40))) for b, x in odds.items()}
        done = sum(c * abs(new[b] - p[b]) for b, c in ballots) < 1e-6 * n
        p = new
        if done:
            break
    return p


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    """Log odds of each feature, and the prior's, from stored candidates.

    The driver gets counts of ballots and of features, both bounded by their
    kinds and not by the corpus.
    """
    cand = found.select(F.explode("found").alias("c"))
    votes = F.concat_ws(",", *[v.cast("string") for v in ballot(F.col("c"))])
    counts = cand.groupBy(F.col("c.kind").alias("kind"), votes.alias("votes")).count().collect()
    chance = {}
    for kind in range(len(KINDS)):
        own = [(tuple(map(int, r["votes"].split(","))), r["count"]) for r in counts if r["kind"] == kind]
        chance |= {f"{kind}:{','.join(map(str, b))}": p for b, p in reliabilities(own).items()}
    if not chance:
        return {}, -1.0
    p = F.element_at(F.create_map(*[F.lit(x) for kv in chance.items() for x in kv]), F.concat(F.col("c.kind").cast("string"), F.lit(":"), votes))
    soft = cand.select(p.alias("p"), F.explode(F.array(*features(F.col("c")))).alias("feature")).groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes, no = (sum(r[x] for r in soft if r["feature"].startswith("kind|")) for x in ("yes", "no"))
    return {r["feature"]: math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2)) for r in soft}, math.log((yes + 1) / (no + 1))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of struct (s, kind, e), ordered, one row per row of ``docs``."""
    found = store(candidates(docs, id_col, text_col), "candidates")
    model, prior = train(found)
    # A map for each feature: looking up takes as long as a map has entries.
    maps = [[F.lit(x) for kv in model.items() if kv[0].startswith(f"{name}|") for x in kv] for name in FEATURES]

    def likely(c):
        found = [F.coalesce(F.try_element_at(F.create_map(*m), f), F.lit(0.0)) if m else F.lit(0.0) for m, f in zip(maps, features(c))]
        score = F.lit(prior)
        for x in found:
            score = score + x
        return score >= 0

    place = lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))
    base = F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), place))
    more = F.array_sort(F.transform(F.filter("found", lambda c: ~c["base"] & likely(c)), place))
    out = found.select("id", base.alias("base"), more.alias("more"))
    return out.select("id", "base", F.expr(_free()).alias("added"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8(spark, sf_dir):
    out = find(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "added"))
    count = lambda spans, i: F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("long")
    counts = [count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[: len(BASE)])]
    more = [count("added", i).alias(f"n_{k}") for i, k in enumerate(KINDS) if k not in BASE]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"), *more, F.size(every).cast("long").alias("n_spans"))
