"""Secret scan: candidates by pattern, judged by a random forest.

Candidates are runs of 12 characters or more of a token's alphabet with a digit or a known beginning, private-key blocks with whatever
stands in them, and what is quoted or assigned after a word that announces a secret, whatever its alphabet and length. The forest sees the
candidate's length, its marks, its transitions between kinds of characters, the share that dictionary words cover, its path, and the
neighbouring words. It is grown on the driver from labelled findings, at most `train_limit` of them, and becomes a Spark conditional
expression; finding, judging and redacting are expressions over one row, and nothing is shuffled.

Labelled findings are a table (secret, before, path, label). Where none is given they are made by rule from a seed: keys of known and of
free form behind words that announce them, against numbers, digests, identifiers and placeholders in their usual places.

A null or empty text has no findings. Repeated rows and null ids are scanned each; ties need no rule, findings don't overlap. A
very long text is scanned whole, in one pass; an empty table has no findings."""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import bound

KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?!-----)[\s\S])*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}|(?:AKIA|ASIA|gh[opsu]_|sk_live_|xox[abp]-|AIza|eyJ)[A-Za-z0-9+/_-]{8,})={0,2}"
WORDS = "secret|token|passw|passphrase|pwd|api.?key|key|auth|bearer|credential|private"
#: Up to a value: the announcing word, then "=", ":" or the like, or a blank where the value is quoted.
LEAD = rf"(?i:{WORDS})[\w.-]{{0,16}}+[\"'`\]]{{0,2}}(?:\s*+(?:=>|:=|[=:])\s*+|\s++(?=[\"'`]))"
NEXT = rf"(?!(?i:{WORDS})[\w.-]{{0,16}}[=:])"
#: What lies before a candidate, from the last one on, and the candidate, group CANDIDATE. The empty groups 2 to 4 tell which kind of value is announced.
FIND = rf"\G((?s:.)*?(?:(?={KEY_BLOCK})|{LEAD}(?!{KEY_BLOCK})(?:\"()(?=[^\"\n]+\")|'()(?=[^'\n]+')|(){NEXT}(?=[^\s\"'`]))|(?={TOKEN})))({KEY_BLOCK}|\2[^\"\n]+|\3[^'\n]+|\4(?:{NEXT}[^\s\"'`])*[^\s\"'`.,;:)\]}}>]|{TOKEN})"
CANDIDATE = 5
#: Characters before a candidate that the forest sees, and candidates whose starts are summed up at a time.
BEFORE, BLOCK = 60, 256
FEATURES = ("length", "transitions", "digits", "distinct", "dictionary", "path", "test_path", "announced", "assigned", "ordinary", "format", "marks")
# Words that identifiers, paths and placeholders are made of.
DICTIONARY = ("access", "account", "admin", "api", "auth", "build", "cache", "change", "class", "client", "code", "config", "data", "default", "demo", "dummy", "error", "example", "file", "foo", "function", "group", "here", "home", "image", "index", "item", "key", "list", "local", "model", "module", "name", "node", "number", "order", "page", "password", "path", "project", "public", "release", "report", "sample", "secret", "server", "service", "source", "static", "string", "table", "task", "test", "text", "time", "token", "type", "user", "value", "version", "your")
ANNOUNCES = rf"(?i)({WORDS})[\w.-]{{0,16}}[^\w]{{0,6}}$"
ORDINARY = r"(?i)(sha|md5|commit|hash|checksum|digest|uuid|guid|isbn|card|iban|phone|tel|fax|order|invoice|ticket|revision|version|build|id|no)[^\w]{0,5}$"
FORMAT = r"^(AKIA|ASIA|gh[opsu]_|sk_live_|xox[abp]-|AIza|eyJ|-----BEGIN)"


def describe(secret: Column, before: Column, path: Column) -> Column:
    """The forest's features."""
    n = F.char_length(secret)
    share = lambda x: x / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    count = lambda pattern: F.regexp_count(secret, F.lit(pattern))
    return F.struct(
        n.cast("double").alias("length"),
        share(count("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")).alias("transitions"),
        share(count("[0-9]")).alias("digits"),
        share(F.size(F.array_distinct(F.split(secret, "")))).alias("distinct"),
        (1 - share(F.char_length(F.regexp_replace(F.lower(secret), "|".join(DICTIONARY), "")))).alias("dictionary"),
        (count("/") + flag(F.regexp_like(before, F.lit(r"(://|[./\\])\S*$")))).cast("double").alias("path"),
        flag(F.regexp_like(path, F.lit("(?i)(test|example|sample|fixture|mock)"))).alias("test_path"),
        flag(F.regexp_like(before, F.lit(ANNOUNCES))).alias("announced"),
        flag(F.regexp_like(before, F.lit(r"[=:]\s*[\"']?$"))).alias("assigned"),
        flag(F.regexp_like(before, F.lit(ORDINARY))).alias("ordinary"),
        flag(F.regexp_like(secret, F.lit(FORMAT))).alias("format"),
        share(count("[^A-Za-z0-9+/_=-]")).alias("marks"),
    )


def default_findings(seed: int = 7, of_each: int = 60) -> list[tuple[str, str, str, int]]:
    """Made by rule: (secret, text before it, path, label)."""
    r = random.Random(seed)
    some = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    prose = lambda: " ".join(some(string.ascii_lowercase, 2, 9) for _ in range(r.randint(3, 8)))
    word = lambda: r.choice(["password", "passwd", "token", "secret", "api_key", "auth_token", "client_secret", "access_key", "Bearer", "private_key"])
    lead = lambda: word() + r.choice(["=", " = ", ": ", ' = "', '="', ":", " "])
    common = lambda: r.choice(["commit ", "sha256: ", "md5 ", "uuid ", "order ", "card ", "invoice no ", "id: ", "build ", "checksum=", "version "])
    path = lambda: r.choice(["", "notes", "app/main", "mail/archive", "docs/guide"])
    digit = lambda s: s if any(c.isdigit() for c in s) else s[:-1] + "7"
    rows = []
    for _ in range(of_each):
        rows += [
            ("AKIA" + some(upper, 16, 16), f"{prose()} ", path(), 1), ("AKIA" + some(upper, 16, 16), f"{prose()} {lead()}", path(), 1), ("ghp_" + digit(some(alnum, 36, 36)), f"{prose()} {lead()}", path(), 1),
            (digit(some(hexa, 16, 64)), f"{prose()} {lead()}", path(), 1), (digit(some(alnum, 16, 48)), f"{prose()} {lead()}", path(), 1), (digit(some(alnum + "+/", 24, 60)), f"{prose()} {lead()}", path(), 1),
            (some(string.digits, 12, 19), f"{prose()} ", path(), 0), (some(string.digits, 12, 19), f"{prose()} {common()}", path(), 0), (digit(some(hexa, 32, 64)), f"{prose()} {common()}", path(), 0), (digit(some(hexa, 40, 40)), f"{prose()} ", path(), 0),
            ("-".join(digit(some(hexa, n, n)) for n in (8, 4, 4, 4, 12)), f"{prose()} {r.choice([common(), ''])}", path(), 0), (digit("_".join(r.choice(DICTIONARY) for _ in range(3))) + "2", f"{prose()} {r.choice([lead(), ''])}", path(), 0),
            (f"{r.choice(DICTIONARY)}/{r.choice(DICTIONARY)}/{some(string.ascii_lowercase, 3, 8)}{r.randint(1, 99)}", f"{prose()} https://", path(), 0), (f"your_{r.choice(DICTIONARY)}_here_{r.randint(1, 9)}", f"{prose()} {lead()}", r.choice([path(), "docs/example"]), 0),
            (some(string.ascii_lowercase, 10, 18) + str(r.randint(1, 2999)), f"{prose()} ", path(), 0), (digit(some(alnum, 16, 40)), f"{prose()} {lead()}", "tests/fixtures", 0), (some(string.digits, 14, 16), f"{prose()} {lead()}", path(), 0), (digit(some(alnum, 20, 40)), f"{prose()} ", path(), 1),
        ]
    letters, marks = string.ascii_letters, "!@#$%^&*?~"
    spoken = lambda n: "-".join(some(string.ascii_lowercase, 4, 8) for _ in range(n))
    assign = lambda: word() + r.choice(["=", " = ", ": ", ' = "', '="', " '"])
    header = lambda: r.choice(["", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{some(hexa.upper(), 32, 32)}\n\n"])
    block = lambda: f"-----BEGIN PRIVATE KEY-----\n{header()}{some(alnum + '+/', 8, r.choice([40, 2000]))}\n-----END PRIVATE KEY-----"
    for _ in range(of_each):
        rows += [
            (some(alnum, 3, 8) + r.choice(marks) + some(alnum + marks, 3, 12), f"{prose()} {assign()}", path(), 1), (some(letters, 3, 8) + r.choice(marks) + some(letters + marks, 3, 8), f"{prose()} {assign()}", path(), 1),
            (spoken(r.randint(3, 5)), f"{prose()} {assign()}", path(), 1), (digit(some(alnum, 6, 11)), f"{prose()} {assign()}", path(), 1), (some(letters, 16, 40), f"{prose()} {assign()}", path(), 1), ("AKIA" + some(letters.upper(), 16, 16), f"{prose()} {r.choice([assign(), ''])}", path(), 1),
            (some(letters, 60, 90) + some(alnum, 4, 20), f"{prose()} {assign()}", path(), 1), (block(), f"{prose()} {r.choice([assign(), ''])}", path(), 1),
            (some(string.ascii_lowercase, 2, 9), f"{prose()} {assign()}", path(), 0), (r.choice(DICTIONARY), f"{prose()} {assign()}", path(), 0), (r.choice(["<", "${", "{{", "os.environ[", "%("]) + r.choice(DICTIONARY), f"{prose()} {assign()}", path(), 0),
            (" ".join(some(string.ascii_lowercase, 2, 9) for _ in range(r.randint(2, 6))), f"{prose()} {assign()}", path(), 0), ("*" * r.randint(3, 12), f"{prose()} {assign()}", path(), 0), ("_".join(r.choice(DICTIONARY) for _ in range(2)), f"{prose()} {assign()}", path(), 0),
            (some(string.ascii_lowercase, 2, 8) + r.choice("!?"), f"{prose()} {word()}: ", path(), 0),
        ]
    return rows


Tree = float | tuple[int, float, "Tree", "Tree"]


def grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int, tried: int) -> Tree:
    """A tree: a share of label 1, or (feature, threshold, at most it, above it)."""
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return round(float(y.mean()), 4)
    best, found = len(y) * y.mean() * (1 - y.mean()) - 1e-9, None
    for f in r.choice(x.shape[1], tried, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, p = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            n = cut + 1.0
            impure = p[cut] * (1 - p[cut] / n) + (p[-1] - p[cut]) * (1 - (p[-1] - p[cut]) / (len(y) - n))
            k = int(np.argmin(impure))
            if impure[k] < best:
                best, found = impure[k], (int(f), round(float(v[cut[k]] + v[cut[k] + 1]) / 2, 6))
    if found is None:
        return round(float(y.mean()), 4)
    low = x[:, found[0]] <= found[1]
    if low.all() or not low.any():
        return round(float(y.mean()), 4)
    return (*found, grow(x[low], y[low], r, depth - 1, tried), grow(x[~low], y[~low], r, depth - 1, tried))


def forest(spark: SparkSession, findings: DataFrame | None = None, trees: int = 15, depth: int = 6, train_limit: int = 4000, seed: int = 11) -> list[Tree]:
    if findings is None:
        findings = spark.createDataFrame(default_findings(), "secret string, before string, path string, label int")
    known = findings.where("label in (0, 1) and secret is not null and secret <> ''")
    rows = known.orderBy(F.xxhash64("secret", "before"), "label").limit(train_limit).select("label", describe(F.col("secret"), F.col("before"), F.col("path")).alias("f")).collect()
    if not rows:
        return [0.0]
    x, y, r = np.array([[*row["f"]] for row in rows], float), np.array([row["label"] for row in rows], float), np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = r.integers(0, len(y), len(y))
        out.append(grow(x[pick], y[pick], r, depth, 4))
    return out


def voted(trees: list[Tree], f: Column) -> Column:
    def one(t: Tree) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(f[FEATURES[t[0]]] <= t[1], one(t[2])).otherwise(one(t[3]))

    return sum((one(t) for t in trees[1:]), one(trees[0])) / len(trees)


def found_in(text: Column, path: Column, trees: list[Tree]) -> Column:
    """array<struct<gap, start, secret, score>> in order of start (0-based characters); gap is what lies before, from the last one on.

    Starts are sums of lengths, and what stands before a candidate is handed on, so no string is searched or cut from its
    beginning again. The sums go by blocks of BLOCK, so that little is copied."""
    kind = "struct<pos:int,tail:string,out:array<struct<gap:string,start:int,secret:string,score:double>>>"
    none = F.expr(f"cast(array() as {kind[kind.index('array') : -1]})")

    def step(acc: Column, x: Column) -> Column:
        def judged(before: Column) -> Column:
            start = acc["pos"] + F.char_length(x["gap"])
            own = F.struct(x["gap"].alias("gap"), start.alias("start"), x["secret"].alias("secret"), bound(describe(x["secret"], before, path), lambda f: voted(trees, f)).alias("score"))
            return F.struct((start + F.char_length(x["secret"])).alias("pos"), last(F.concat(before, x["secret"])).alias("tail"), F.concat(acc["out"], F.array(own)).alias("out")).cast(kind)

        return bound(last(F.concat(acc["tail"], x["gap"])), judged)

    last = lambda x: F.substring(x, -BEFORE, BEFORE)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.char_length(x["gap"]) + F.char_length(x["secret"]))

    def each(t: Column) -> Column:
        def blocks(found: Column) -> Column:
            cut = F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found), F.lit(BLOCK)), lambda i: F.slice(found, i, BLOCK)))
            return F.when(F.size(found) > 0, bound(cut, lambda own: bound(starts(own), lambda at: F.flatten(F.zip_with(own, at, lambda x, p: F.aggregate(x, F.struct(p, before(p), none).cast(kind), step, lambda acc: acc["out"])))))).otherwise(none)

        starts = lambda own: F.aggregate(F.transform(own, total), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)), lambda acc: F.slice(acc, 1, F.size(own)))
        before = lambda p: F.substring(t, F.greatest(p - BEFORE, F.lit(0)) + 1, F.least(p, F.lit(BEFORE)))
        return bound(F.zip_with(F.regexp_extract_all(t, F.lit(FIND), F.lit(1)), F.regexp_extract_all(t, F.lit(FIND), F.lit(CANDIDATE)), lambda g, c: F.struct(g.alias("gap"), c.alias("secret"))), blocks)

    return bound(F.coalesce(text, F.lit("")), each)


def _path(docs: DataFrame, path_col: str | None) -> Column:
    return F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row per candidate: doc_id, start, length, secret, score, is_secret."""
    trees = forest(docs.sparkSession, findings)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline(found_in(F.col(text_col).cast("string"), _path(docs, path_col), trees)))
    return rows.select("doc_id", "start", F.char_length("secret").alias("length"), "secret", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, mark: str = "<secret>", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs with each secret in the text replaced by mark; other columns as they were. A null text stays null."""
    trees, t = forest(docs.sparkSession, findings), F.col(text_col)

    def rebuilt(found: Column) -> Column:
        parts = F.array_join(F.transform(found, lambda f: F.concat(f["gap"], F.when(f["score"] >= threshold, F.lit(mark)).otherwise(f["secret"]))), "")
        end = F.element_at(found, -1)
        return F.when(F.exists(found, lambda f: f["score"] >= threshold), F.concat(parts, F.substring(t, end["start"] + F.char_length(end["secret"]) + 1, F.char_length(t)))).otherwise(t)

    return docs.withColumn(text_col, bound(found_in(t.cast("string"), _path(docs, path_col), trees), rebuilt))


def op1(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
