"""Linking of the spellings of one person or organisation by canonical rewritings of names."""

from __future__ import annotations

from collections.abc import Container

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.llm.components import connected_groups
from ledgermill.operators.skew import skew_join_unique
from ledgermill.session import cut_lineage

#: Titles and forms of address.
TITLES = set("mr mrs ms miss shri smt sri dr prof kum kumari adv ca er m/s messrs the".split())
#: Legal forms, each with its one canonical writing.
LEGAL = {
    "limited": "ltd", "ltd": "ltd", "limted": "ltd", "private": "pvt", "pvt": "pvt", "p": "pvt", "llp": "llp", "corporation": "corp", "corp": "corp", "corpn": "corp",
    "company": "co", "co": "co", "incorporated": "inc", "inc": "inc", "plc": "plc", "india": "",
}
#: Short forms of words in company names; others are found by their letters.
SHORT_WORDS = {
    "mfg": "manufacturing", "engg": "engineering", "hldgs": "holdings", "intl": "international", "svcs": "services", "invts": "investments",
    "secs": "securities", "inds": "industries", "infra": "infrastructure", "fin": "finance", "tech": "technologies", "pharma": "pharmaceuticals", "telecoms": "telecom",
    "chem": "chemicals", "ins": "insurance", "logs": "logistics",
}
#: Familiar forms of given names.
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bill": "william", "will": "william", "liz": "elizabeth", "beth": "elizabeth", "kate": "katherine", "kathy": "katherine",
    "mike": "michael", "nick": "nicholas", "tom": "thomas", "joe": "joseph", "alex": "alexander", "fred": "frederick", "ed": "edward", "ted": "theodore", "theo": "theodore",
    "debbie": "deborah", "maggie": "margaret", "peggy": "margaret", "chris": "christopher", "zach": "zachariah", "zac": "zachariah", "ozzie": "oswald", "venky": "venkatesh",
    "subbu": "subramaniam", "paddy": "padmanabhan", "sid": "siddharth", "dev": "devendra", "sanju": "sanjay",
    "raju": "rajendra", "vicky": "vikram", "shekhar": "chandrashekhar", "bala": "balasubramaniam", "yogi": "yogeshwar", "guru": "gurpreet", "ishwar": "ishwarchand", "harish": "harishchandra",
}
#: Spellings of one sound, each written as the second.
SOUNDS = {"ee": "i", "oo": "u", "sh": "s", "ph": "f"}
_COMPANY = re.compile(r"(?i)\b(?:[l1]imi?ted|ltd|[l1]{2}p|l\.l\.p|corp(?:oratio?n|n)?|pvt|private|m/s)\b")
_FORMER = re.compile(r"(?i)\(\s*(?:formerly|erstwhile|previously|earlier|f/?k/?a|now)\b.*$")
_ODD = str.maketrans("0158!|á", "olsbiia")
FULL, INITIAL, CUT = 0, 1, 2
#: A spelling this many times as common as another is the right one, however many strings have the other.
RIGHT = 5


def parse(name: str, kind: str | None, common: Container[str] = frozenset()) -> tuple[str, list[tuple[int, str, int, bool]], str | None]:
    """(kind, tokens, nickname): tokens are (place, text, FULL | INITIAL | CUT, is a legal form).

    Titles, marks, a former name and the case are gone; misread characters are read as letters; run-together
    words with inner capitals and initials are taken apart. kind is person or company; if it is not given, a legal form
    or a word of common, the usual words of company names, makes a company.
    """
    s = _FORMER.sub("", name)
    if kind not in ("person", "company"):
        apart = re.findall(r"\p{L}+", re.sub(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ", s).lower())
        kind = "company" if _COMPANY.search(s) or any(w in common for w in apart) else "person"
    nick = None
    m = re.search(r"[\"“'(]\s*(\p{L}+)\s*[\"”')]", s)
    if m and kind == "person":
        nick, s = m.group(1).lower(), s[: m.start()] + " " + s[m.end() :]
    s = re.sub(r"(?i)^\s*m/s\.?\s*", "", s)
    s = re.sub(r"(?i)\bL\.?L\.?P\b\.?", "LLP", s)
    s = re.sub(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ", s)
    comma = kind == "person" and "," in s
    words = re.findall(r"[\p{L}\p{M}0-9!|']+\.?", s)
    out: list[tuple[int, str, int, bool]] = []
    for w in words:
        dot, raw = w.endswith("."), w.rstrip(".")
        t = raw.lower().translate(_ODD).replace("'", "")
        if not t or (t in TITLES and len(words) > 1 and not (kind == "company" and t == "ca")):
            continue
        if kind == "company":
            if t in LEGAL or (t.startswith("lim") and t.endswith("ted")):
                out.append((len(out), LEGAL.get(t, "ltd"), FULL, True))
                continue
            t = SHORT_WORDS.get(t, t)
        if kind == "person" and len(t) == 2 and raw.isupper() and len(words) <= 3 and not dot and not s.isupper():
            out += [(len(out) + i, c, INITIAL, False) for i, c in enumerate(t)]
        elif len(t) == 1:
            out.append((len(out), t, INITIAL, False))
        else:
            out.append((len(out), t, CUT if dot and (kind == "company" or len(t) <= 5) and t not in SHORT_WORDS.values() else FULL, False))
    if comma and out:
        first = len(re.findall(r"[\p{L}0-9!|']+", s.split(",")[0]))
        titles = sum(1 for w in re.findall(r"[\p{L}]+", s.split(",")[0]) if w.lower() in TITLES)
        k = max(0, first - titles)
        out = [(i, *x[1:]) for i, x in enumerate(out[k:] + out[:k])]
    return kind, out, nick


def one_sound(c: Column) -> Column:
    for a, b in SOUNDS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def deletions(t: str) -> list[str]:
    """t and all strings with one character less; two strings one edit or swap apart share at least one."""
    return list(dict.fromkeys([t, *(t[:i] + t[i + 1 :] for i in range(len(t)))]))


def one_slip(a: str, b: str) -> bool:
    """True if one insertion, deletion, substitution or swap of neighbours makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _each_name(records: DataFrame) -> DataFrame:
    """(name, kind, din) of every non-blank string of the four fields; din only where it is no void number."""
    schema = "person_name string, din string, company_name string, counterparty_name string, holder_name string, holder_kind string"
    p = records.where("record_type in ('directors', 'rpt', 'shareholding')").select("record_type", F.from_json("payload_json", schema).alias("p"))
    good = F.expr("case when p.din rlike '^[0-9]{8}$' and not p.din rlike '^0+$' then p.din end")
    none = F.lit(None).cast("string")

    def row(name, kind, din):
        return F.struct(name.alias("name"), kind.alias("kind"), din.alias("din"))

    each = p.select(F.explode(F.when(F.col("record_type") == "directors", F.array(row(F.col("p.person_name"), F.lit("person"), good), row(F.col("p.company_name"), F.lit("company"), none)))
        .when(F.col("record_type") == "rpt", F.array(row(F.col("p.counterparty_name"), none, none)))
        .otherwise(F.array(row(F.col("p.holder_name"), F.when(F.col("p.holder_kind").isin("person", "company"), F.col("p.holder_kind")), none)))).alias("x")).select("x.*")
    return each.where("name is not null and trim(name) <> ''")


def name_strings(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, n, kind, din) and (name, din): the distinct strings with their records, stated kind and only number; all numbers.

    A string's numbers stay rows: a common name may have any number of them.
    """
    numbered = cut_lineage(_each_name(records).groupBy("name", "din").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")))
    one = F.when(F.min("din") == F.max("din"), F.min("din"))
    strings = numbered.groupBy("name").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"), one.alias("din"))
    return strings, numbered.where("din is not null").select("name", "din")


_TOKENS = "struct<kind:string,nick:string,tokens:array<struct<place:int,t:string,form:int,legal:boolean>>>"


def _vertex() -> Column:
    """A string as a vertex; vertices of forms start with other letters."""
    return F.concat(F.lit("n"), "name")


def _grows(df: DataFrame) -> DataFrame:
    """df for the right side of a join, where it grows with the data and is not to be broadcast."""
    return df.hint("merge")




def company_words(strings: DataFrame) -> dict[str, int]:
    """Words, with their counts, that make up a 150th or more of all words of company names, so fewer than 150; legal forms left out."""
    firm = strings.where(F.expr("kind = 'company' or name rlike '(?i)\\\\b(limited|ltd|llp|private|corporation)\\\\b'"))
    plain = F.regexp_replace(F.regexp_replace("name", r"\(.*$", ""), r"([a-z])([A-Z][a-z])", "$1 $2")
    w = firm.select(F.explode(F.split(F.lower(plain), r"[^\p{L}]+")).alias("t")).where(F.length("t") > 3).where(~F.col("t").isin(*[k for k in LEGAL])).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    total = w.agg(F.sum("c").alias("s"))
    return {r["t"]: r["c"] for r in w.join(F.broadcast(total), F.col("c") * 150 >= F.col("s")).select("t", "c").collect()}


def _token_table(strings: DataFrame, common: dict[str, int]) -> DataFrame:
    @F.pandas_udf(_TOKENS)
    def read(name: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for s, k in zip(name, kind):
            kind_, toks, nick = parse(s, k, common)
            out.append({"kind": kind_, "nick": nick, "tokens": [{"place": p, "t": t, "form": f, "legal": g} for p, t, f, g in toks]})
        return pd.DataFrame(out, columns=["kind", "nick", "tokens"])

    return strings.withColumn("x", read("name", "kind")).select("name", "n", "din", "x.kind", "x.nick", "x.tokens")


def respellings(tokens: DataFrame) -> DataFrame:
    """(kind, t, good): for each word a much commoner one that one slip makes it from.

    tokens has name, n, kind, t, form, legal. Words are compared by equi-join on their one-deletion forms. A word is
    replaced when RIGHT times as many strings and records have the other. Of up to three strings, too few for a ratio to
    say much, three times as many, or more strings with twice the records, or at a tie thrice the records, do.
    """
    v = tokens.where(f"form = {FULL} and not legal and length(t) >= 4").groupBy("kind", "t").agg(F.count_distinct("name").alias("df"), F.sum("n").alias("n"))
    v = cut_lineage(v)

    @F.pandas_udf("array<string>")
    def forms(s: pd.Series) -> pd.Series:
        return s.map(deletions)

    @F.pandas_udf("boolean")
    def slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_slip(x, y) and not (x[1:] == y[1:] and len(x) < 7) for x, y in zip(a, b)])

    keyed = v.withColumn("key", F.explode(forms("t")))
    other = keyed.select("kind", "key", "t", F.col("df").alias("rdf"), F.col("n").alias("rn"))
    few = "rdf <= 3 and (df >= 3 * rdf or (df > rdf and n >= 2 * rn) or (df = rdf and n >= 3 * rn))"
    pairs = other.join(_grows(keyed.withColumnRenamed("t", "good")), ["kind", "key"]).where(
        f"good <> t and (({few}) or (df >= {RIGHT} * rdf and n >= {RIGHT} * rn))").select("kind", "t", "good", "df", "n").distinct()
    return pairs.where(slip("t", "good")).groupBy("kind", "t").agg(F.max_by("good", F.struct("df", "n", "good")).alias("good"))


def canonical_tokens(strings: DataFrame, common: dict[str, int]) -> DataFrame:
    """strings with kind, nick and tokens rewritten: (name, n, din, kind, nick, toks: place, t, form, legal, last)."""
    table = cut_lineage(_token_table(strings, common))
    flat = table.select("name", "n", "kind", F.explode("tokens").alias("k")).select("name", "n", "kind", "k.*")
    fixed = flat.withColumn("raw", F.col("t"))
    # slips are undone before spellings of one sound are made equal, and again after
    for step in range(2):
        fixes = cut_lineage(respellings(fixed))
        again = fixes.select("kind", F.col("t").alias("good"), F.col("good").alias("better"))  # a slip of a slip
        fixes = fixes.join(_grows(again), ["kind", "good"], "left").select("kind", "t", F.coalesce("better", "good").alias("good"))
        good = F.when(F.col("form") == FULL, F.coalesce("good", "t")).otherwise(F.col("t"))
        fixed = fixed.join(_grows(fixes), ["kind", "t"], "left").withColumn("t", good).drop("good")
        if step == 0:
            fixed = cut_lineage(fixed.withColumn("t", F.when(F.col("kind") == "person", one_sound(F.col("t"))).otherwise(F.col("t"))))
    size = F.max("place").over(Window.partitionBy("name"))
    fixed = cut_lineage(fixed.withColumn("size", size))
    last = fixed.where(f"form = {FULL}").groupBy("kind", "t").agg(
        F.avg((F.col("place") == F.col("size")).cast("double")).alias("last"), F.count_distinct("name").alias("df"))
    words = fixed.join(_grows(last), ["kind", "t"], "left")
    listed = words.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("legal"), F.struct("place", "raw")))), lambda x: x["raw"]), "").alias("raw_run"), F.sort_array(F.collect_list(F.struct("place", "t", "form", "legal", F.coalesce("last", F.lit(0.0)).alias("last"), F.coalesce("df", F.lit(0)).alias("df")))).alias("toks"))
    return table.select("name", "n", "din", "kind", "nick").join(_grows(listed), "name", "left").where("toks is not null")


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def company_forms(toks: list[dict], common: dict[str, int]) -> dict:
    """core words, the run-together writing and the legal form of a company name; common, with counts, expands cut words.

    A word without a dot is cut when at most two strings have it or the whole word is RIGHT times as common.
    """
    core = []
    for x in toks:
        if x["legal"]:
            continue
        t = x["t"]
        if x["form"] == CUT or t not in common:
            fits = [w for w in common if (x["form"] == CUT or x["df"] <= 2 or common[w] >= RIGHT * x["df"]) and w[0] == t[0] and len(w) > len(t) and _subsequence(t, w) and (w.startswith(t) or len(t) <= 5)]
            if len(fits) > 1:
                fits = [w for w in fits if w.startswith(t)] or fits
            if x["form"] == CUT and len(fits) == 1 or (len(fits) == 1 and fits[0].startswith(t)):
                t = fits[0]
        core.append(t)
    return {"words": " ".join(sorted(core)), "run": "".join(core), "size": len(core)}


def person_forms(toks: list[dict], nick: str | None) -> dict:
    """given, middles and surname of a person name, each FULL, INITIAL or CUT, with the surname put last."""
    words = [(x["t"], x["form"], x["last"]) for x in toks]
    if len(words) >= 2 and words[0][1] == FULL and len(words[0][0]) > 2:
        first, final = words[0], words[-1]
        if final[1] != FULL or (first[2] > final[2] + 0.2):
            words = words[1:] + words[:1]
    if not words:
        return {"given": "", "gform": INITIAL, "middle": [], "surname": ""}
    given, gform, _ = words[0]
    if len(words) == 1:
        return {"given": given, "gform": gform, "middle": [], "surname": ""}
    return {"given": given, "gform": gform, "middle": [t for t, _, _ in words[1:-1]], "surname": words[-1][0]}


_FORMS = "struct<words:string,run:string,size:int,given:string,gform:int,middle:array<string>,surname:string>"


def name_groups(records: DataFrame, min_rarity: float = 1.0) -> DataFrame:
    """(name, root): strings of equal root name the same person or organisation; strings linked to no other are left out.

    Every string's rewritings are forms that equal strings share: for companies the sorted core words and the
    run-together letters, each without legal form; for persons given name, middle name and surname in full, without
    middle name, with initials, with a familiar or cut given name. Strings meet by equi-join on forms. A rewriting scores
    by its rarity, one over the number of fuller names that have it, and links from min_rarity on: at 1 only where a short
    form can mean one person. Equal official numbers are one more form; full names with different numbers are different
    persons.
    """
    strings, numbers = name_strings(records)
    strings = cut_lineage(strings)
    common = company_words(strings)
    toks = cut_lineage(canonical_tokens(strings, common))

    @F.pandas_udf(_FORMS)
    def forms(kind: pd.Series, toks: pd.Series, nick: pd.Series) -> pd.DataFrame:
        empty = {"words": None, "run": None, "size": None, "given": None, "gform": None, "middle": None, "surname": None}
        rows = []
        for k, t, n in zip(kind, toks, nick):
            rows.append(empty | (company_forms(list(t), common) if k == "company" else person_forms(list(t), n)))
        return pd.DataFrame(rows, columns=list(empty))

    f = cut_lineage(toks.withColumn("x", forms("kind", "toks", "nick")).select("name", "n", "din", "kind", "nick", "raw_run", "x.*"))
    as_written = f.where("length(raw_run) >= 8 and not contains(name, '(')").select(_vertex().alias("src"), F.concat(F.lit("q"), F.left("kind", F.lit(1)), "raw_run").alias("dst"))
    edges = _company_links(f.where("kind = 'company' and run <> ''")).unionByName(_person_links(f.where("kind = 'person' and surname <> ''"), numbers, min_rarity))
    by_number = numbers.select(_vertex().alias("src"), F.concat(F.lit("d"), "din").alias("dst"))
    return connected_groups(edges.unionByName(by_number).unionByName(as_written)).where(F.col("id").startswith("n")).select(F.substring("id", 2, 1 << 30).alias("name"), "root")


def _company_links(c: DataFrame) -> DataFrame:
    """Edges from strings to the vertices of their forms; run-together forms one slip apart are linked towards the commoner."""
    words = c.where("size > 0").select(_vertex().alias("src"), F.concat(F.lit("w"), "words").alias("dst"))
    run = c.select(_vertex().alias("src"), F.concat(F.lit("r"), "run").alias("dst"))
    runs = cut_lineage(c.groupBy("run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df")).where("length(run) >= 8"))

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(deletions)

    @F.pandas_udf("boolean")
    def slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_slip(x, y) for x, y in zip(a, b)])

    k = runs.withColumn("key", F.explode(cut("run")))
    near = k.select("key", F.col("run").alias("a"), F.col("n").alias("an"), F.col("df").alias("adf")).join(_grows(k.select("key", F.col("run").alias("b"), F.col("n").alias("bn"), F.col("df").alias("bdf"))), "key")
    near = near.where(f"a <> b and ((adf <= 2 and (bn > an or (bn = an and a < b))) or (bdf >= adf and bn >= {RIGHT} * an))").select("a", "b").distinct().where(slip("a", "b"))
    return words.unionByName(run).unionByName(near.select(F.concat(F.lit("r"), "a").alias("src"), F.concat(F.lit("r"), "b").alias("dst")))


def _nicknames(p: DataFrame, numbers: DataFrame) -> DataFrame:
    """(given, other): familiar given names and the one full name each stands for.

    From quotes, equal official numbers, rare beginnings of common given names beside the same surname, and a fixed list.
    """
    quoted = p.where(f"nick is not null and gform = {FULL} and nick <> given").select(F.col("nick").alias("given"), F.col("given").alias("other"), F.lit(5).alias("w"))
    one = numbers.join(_grows(p.where(f"gform = {FULL}").select("name", "surname", "given")), "name").select(F.col("din").alias("d"), "surname", "given").distinct()
    common = p.where(f"gform = {FULL}").groupBy("given").agg(F.count(F.lit(1)).alias("df"))
    pair = one.join(_grows(one.withColumnRenamed("given", "other")), ["d", "surname"]).where("given <> other").groupBy("given", "other").agg(F.count(F.lit(1)).alias("w"))
    pair = pair.join(common, "given").join(common.withColumnRenamed("given", "other").withColumnRenamed("df", "odf"), "other").where("odf > df").select("given", "other", "w")
    # a rare given name that begins a common one of the same surname
    begun = p.where(f"gform = {FULL} and length(given) >= 3").select("surname", "given", F.left("given", F.lit(3)).alias("head")).distinct()
    begun = begun.join(_grows(begun.withColumnRenamed("given", "other")), ["surname", "head"]).where("length(other) >= length(given) + 2 and startswith(other, given)").groupBy("given", "other").agg(F.count(F.lit(1)).alias("w"))
    begun = begun.join(common, "given").join(common.withColumnRenamed("given", "other").withColumnRenamed("df", "odf"), "other").where("odf >= 3 * df").select("given", "other", "w")
    fixed = p.sparkSession.createDataFrame([(a, b, 1) for a, b in NICKNAMES.items()], "given string, other string, w int").select(
        one_sound(F.col("given")).alias("given"), one_sound(F.col("other")).alias("other"), "w")
    quoted = quoted.withColumn("given", one_sound(F.col("given")))
    return quoted.unionByName(pair).unionByName(begun).unionByName(fixed).groupBy("given", "other").agg(F.sum("w").alias("w")).groupBy("given").agg(F.max_by("other", F.struct("w", "other")).alias("other"))


def _person_links(p: DataFrame, numbers: DataFrame, min_rarity: float) -> DataFrame:
    p = skew_join_unique(p.drop("words", "run", "size", "raw_run"), cut_lineage(_nicknames(p, numbers)), "given", "left").withColumn(
        "given", F.when(F.col("gform") == FULL, F.coalesce("other", "given")).otherwise(F.col("given"))).drop("other")
    mid = F.element_at("middle", 1)
    p = p.withColumn("mid", F.when(F.size("middle") > 0, mid)).withColumn("mi", F.left("mid", F.lit(1))).withColumn(
        "mid", F.when(F.length("mid") > 1, F.col("mid")))
    p = cut_lineage(p.select("name", "given", "gform", "mid", "mi", "surname", "din"))
    # a surname broken in two: the last two words together are a commoner surname than the last alone
    known = cut_lineage(p.groupBy("surname").agg(F.count(F.lit(1)).alias("sdf")))
    q = p.withColumn("whole", F.concat("mid", "surname"))
    q = skew_join_unique(q, known.select(F.col("surname").alias("whole"), F.col("sdf").alias("wdf")), "whole", "left")
    q = skew_join_unique(q, known, "surname", "left").withColumn("broken", F.coalesce(F.col("wdf") > F.col("sdf"), F.lit(False)))
    p = cut_lineage(q.select("name", "given", "gform", F.when(~F.col("broken"), F.col("mid")).alias("mid"), F.when(~F.col("broken"), F.col("mi")).alias("mi"), F.when(F.col("broken"), F.col("whole")).otherwise(F.col("surname")).alias("surname"), "din"))
    full = p.where(f"gform = {FULL}")
    gs = full.groupBy("given", "surname").agg(F.count_distinct("mid").alias("mids"), F.max("mid").alias("only"), F.count_distinct("din").alias("numbers"), F.count_distinct("mi").alias("mis"))
    j = full.join(_grows(gs), ["given", "surname"])
    sep = F.lit("\x02")
    one = F.expr("mids <= 1 and mis <= 1 and numbers <= 1")
    # middle names or numbers that differ make several persons of one given name and surname
    initial = full.where("mid is not null").groupBy("given", "surname", "mi").agg(F.count_distinct("mid").alias("k"), F.max("mid").alias("full_mid"))
    j = j.join(_grows(initial), ["given", "surname", "mi"], "left")
    which = F.when(one, F.lit("")).when(F.col("mid").isNotNull(), F.col("mid")).when(F.col("mi").isNotNull(), F.when(F.col("k") == 1, F.col("full_mid")).otherwise(F.concat(F.lit("."), "mi"))).otherwise(
        F.when((F.col("mids") == 1) & (F.col("mis") <= 1) & (F.col("numbers") <= 1), F.col("only")).otherwise(F.lit("-")))
    j = j.withColumn("node", F.concat(F.lit("p"), "given", sep, which, sep, "surname")).withColumn(
        "kmi", F.coalesce(F.when(one, F.left("only", F.lit(1))), F.col("mi")))
    j = cut_lineage(j.select("name", "given", "surname", "node", "kmi", "din"))
    links = j.select(_vertex().alias("src"), F.col("node").alias("dst"))

    # short given names: initial or cut, against the fuller names with that beginning and surname
    ways = F.explode(F.transform(F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(5)), lambda k: F.struct(k.alias("k"), F.left(F.col("given"), k).alias("head"))))
    fuller = j.groupBy("node", "given", "surname").agg(F.max("kmi").alias("kmi"))
    fuller = fuller.select("node", "surname", "kmi", ways.alias("w")).select("node", "surname", "kmi", "w.head").distinct()
    # counted by middle initial first, so that a short form meets a handful of rows, and each short form is decided once
    fuller = fuller.groupBy("head", "surname", "kmi").agg(F.count(F.lit(1)).alias("k"), F.max("node").alias("node"))
    short = cut_lineage(p.where(f"gform <> {FULL}").select("name", F.col("given").alias("head"), "mi", "surname").withColumn(
        "key", F.concat("head", sep, F.coalesce("mi", F.lit("")), sep, "surname")))
    met = short.select("key", "head", "mi", "surname").distinct().join(_grows(fuller), ["head", "surname"])
    met = met.withColumn("fit", F.expr("case when mi is null then 1 when kmi = mi then 2 when kmi is null then 1 else 0 end")).where("fit > 0")
    met = met.groupBy("key", "fit").agg(F.sum("k").alias("k"), F.max("node").alias("node"))
    best = met.groupBy("key").agg(F.max_by(F.struct("k", "node"), "fit").alias("b")).select("key", (1 / F.col("b.k")).alias("rarity"), "b.node")
    pick = skew_join_unique(short.select("name", "key"), best.where(F.col("rarity") >= min_rarity), "key")
    links = links.unionByName(pick.select(_vertex().alias("src"), F.col("node").alias("dst")))
    # short strings that are the same in themselves
    return links.unionByName(short.select(_vertex().alias("src"), F.concat(F.lit("s"), "key").alias("dst")))


#: Members of a group that meet all others in one task.
PART = 1000


def same_pairs(groups: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of different strings of one group, the form TESTDATA.md fixes.

    The pairs of a group of more than PART strings are made in parts of it, so no task makes a large group's square.
    """
    groups = cut_lineage(groups.distinct())
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("fan"))
    sized = skew_join_unique(groups, sizes, "root")
    a = sized.select("root", F.pmod(F.xxhash64("name"), F.col("fan")).cast("int").alias("part"), F.col("name").alias("name_a"))
    b = sized.select("root", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.col("name").alias("name_b"))
    return a.join(_grows(b), ["root", "part"]).where("name_a < name_b").select("name_a", "name_b")
