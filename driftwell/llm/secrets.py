"""Secret scan: candidates by pattern, false positives removed by a random forest, all in SQL functions.

Candidates are of three kinds: what is assigned to a name such as password, token or api_key (8 characters or more,
digits or not); the password of an address ``scheme://user:password@``; and any run of 16 or more letters, digits and
``_+/-`` that holds a digit, dotted web tokens included.  Features are a candidate's length, its mix of characters, how
often their class changes and how likely its letter pairs are in words, how much of it dictionary words cover, whether
it stands in a path or address, and the words around it.  The forest is grown in numpy on the driver from labelled
findings (at most ``FIT_ROWS``; by default made by rule, see ``example_findings``) and then becomes CASE
expressions, so scoring is one narrow pass over the texts: no shuffle, no Python.

Texts without a candidate leave at a filter.  In the others the candidates are fenced with a control
character and the text is split there, which keeps each with what stands before and after it.

Limits: a secret of under 8 characters, or of under 16 without an assignment or address, is never scored; nor is one of
letters alone that nothing names.  The labelled findings are made by rule, as no table holds any.

Defined cases: null and empty texts have no candidates; very long texts are scanned whole; the fence character in a
text reads as a space; repeated rows repeat their findings; null ids are kept; a score that equals the threshold is a
secret; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import random
import string
from collections import Counter
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import table, texts

_RUN = "A-Za-z0-9_+/-"
_NAMES = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key(?:[_-]?id)?|client[_-]?key|private[_-]?key|credential|auth(?:orization)?"
_ASSIGNED = rf"(?i:(?:{_NAMES})[\"']?\s{{0,2}}(?:=>|[:=])\s{{0,2}}[\"']?(?:bearer\s)?)"
_VALUE = r"[^\s\"'<>,;()\[\]{}]{8,}"
_WEB_TOKEN = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"
_LONG = rf"(?<![{_RUN}])(?=[A-Za-z_+/-]*[0-9])[{_RUN}]{{16,}}={{0,2}}"
#: What stands before a candidate is group 1 or 3, the candidate 2, 4 or 5.
CANDIDATE = rf"({_ASSIGNED})({_VALUE})|(://[^\s/:@]{{1,64}}:)([^\s/:@]{{6,}})(?=@)|({_WEB_TOKEN}|{_LONG})"
FENCE = "\x01"
AROUND = 48
FIT_ROWS, TREES, LEVELS, THRESHOLD = 4000, 20, 7, 0.5

#: Words whose presence makes a run read as text or as a placeholder.
DICTIONARY = (
    "about account admin after array base before block build button cache change class client code color column "
    "comment common config content count create data date default demo dummy event example field file filter final "
    "first folder font format from function global group header height here home html image import index info input "
    "insert item label last layout length level library line link list load local main media message method model "
    "module name next node none null number object option order output page param parse path payload place point post "
    "print process project public query read record release report request reset response result return root sample "
    "script search section select server service session size source start state static status step stop storage "
    "string style system table target template test text the thumb time title token type undefined update upload url "
    "user util value version view width with word work write your"
).split()

_KEYWORDS = r"token|secret|passw|passphrase|pwd|api.?key|auth|credential|bearer|private|access.?key|client.?key"
_OTHER_WORDS = r"sha|md5|hash|commit|checksum|digest|uuid|guid|etag|revision|build|order|invoice|card|phone|isbn|version|trace|request.?id"

#: How well-known issuers begin their tokens.
_ISSUERS = "^(gh[pousr]_|github_pat_|glpat-|AKIA|ASIA|AIza|xox[abprs]-|sk-|sk_live_|rk_live_|npm_|hf_|eyJ)"


def _pair_levels() -> str:
    """A digit for each pair of letters, in order: how common the dictionary makes it, 0 for never."""
    n = Counter(a + b for w in DICTIONARY for a, b in pairwise(w))
    letters = string.ascii_lowercase
    return "".join(str(min(9, 2 * n[a + b].bit_length())) for a in letters for b in letters)


_LETTERS = "regexp_replace(lower(candidate), '[^a-z]', '')"
#: Mean level of neighbouring letters, 0 for fewer than two.
_PAIRS_SQL = f"""if(length({_LETTERS}) < 2, 0, aggregate(transform(array({_LETTERS}), w -> aggregate(sequence(1, length(w) - 1), 0D,
    (s, i) -> s + cast(substring('{_pair_levels()}', 26 * (ascii(substring(w, i, 1)) - 97) + ascii(substring(w, i + 1, 1)) - 96, 1) as double)) / (length(w) - 1)), 0D, (s, x) -> s + x))"""

#: Features, by name, over the columns ``candidate``, ``before`` and ``after``.
FEATURES = {
    "length": "length(candidate)",
    "digits": "regexp_count(candidate, '[0-9]') / length(candidate)",
    "upper": "regexp_count(candidate, '[A-Z]') / length(candidate)",
    "lower": "regexp_count(candidate, '[a-z]') / length(candidate)",
    "marks": "regexp_count(candidate, '[_+/=-]') / length(candidate)",
    "transitions": "regexp_count(candidate, '(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[_+/=-])[^_+/=-]') / length(candidate)",
    "distinct": "size(array_distinct(split(candidate, ''))) / least(length(candidate), 64)",
    "hex": "cast(lower(candidate) rlike '^[0-9a-f]+$' as int)",
    "uuid": "cast(lower(candidate) rlike '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$' as int)",
    "dots": "regexp_count(candidate, '[.]') / length(candidate)",
    "odd": "regexp_count(candidate, '[^A-Za-z0-9_+/=.-]') / length(candidate)",
    "template": "cast(candidate rlike '[$%*]{2}|^[$%]|[.]env[.]|^[*.xX]+$' as int)",
    "issuer": f"cast(candidate rlike '{_ISSUERS}' as int)",
    "pairs": _PAIRS_SQL,
    "repeats": "cast(candidate rlike '(.)\\\\1{3,}' as int)",
    "covered": "1 - length(regexp_replace(lower(candidate), '" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + "', '')) / length(candidate)",
    "letters_run": "length(regexp_extract(candidate, '[A-Za-z]{6,}', 0)) / length(candidate)",
    "path": "cast(before rlike '[/\\\\\\\\.@#]$' or after rlike '^[./\\\\\\\\:@]' as int)",
    "slashes": "regexp_count(candidate, '/')",
    "assigned": "cast(before rlike '[=:>][ ]?[\"\\']?$' as int)",
    "quoted": "cast(before rlike '[\"\\']$' and after rlike '^[\"\\']' as int)",
    "address": "cast(before rlike '://[^ /:@]+:$' and after like '@%' as int)",
    "named": f"cast(lower(before) rlike '({_KEYWORDS})[a-z_-]{{0,8}}[\"\\']?[ ]{{0,2}}(=>|[:=])[ ]{{0,2}}[\"\\']?(bearer )?$' as int)",
    "digest": "cast(lower(candidate) rlike '^(sha[0-9]+|md5)-' as int)",
    "keyword": f"cast(lower(right(before, 28)) rlike '{_KEYWORDS}' as int)",
    "other_word": f"cast(lower(right(before, 28)) rlike '{_OTHER_WORDS}' as int)",
}


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, ordinal, candidate, before, after)``; ordinals count from 1 within a text."""
    rows = texts(docs).filter(F.col("text").rlike(CANDIDATE))
    fenced = F.regexp_replace(F.translate("text", FENCE, " "), CANDIDATE, f"$1$3{FENCE}$2$4$5{FENCE}")
    rows = rows.select("doc_id", F.split(fenced, FENCE).alias("parts"))
    found = F.expr(
        f"""transform(sequence(1, size(parts) - 2, 2), i -> named_struct(
              'ordinal', cast((i + 1) div 2 as int), 'candidate', parts[i],
              'before', right(parts[i - 1], {AROUND}), 'after', left(parts[i + 1], {AROUND})))"""
    )
    return rows.select("doc_id", F.inline(found))


def with_features(found: DataFrame) -> DataFrame:
    return found.select("*", *[F.expr(f"cast({sql} as double)").alias(f"f_{name}") for name, sql in FEATURES.items()])


def example_findings(rows: int = FIT_ROWS, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """Labelled findings by rule: (before, candidate, after, 1 for a secret)."""
    r = random.Random(seed)
    base64 = string.ascii_letters + string.digits

    def word() -> str:
        return "".join(r.choice(("th", "er", "an", "de", "ch", "on", "in", "re", "ti", "es", "la", "ge")) for _ in range(r.randint(1, 4)))

    def draw(chars: str, low: int, high: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(low, high)))

    def hexes(n: int) -> str:
        return draw("0123456789abcdef", n, n)

    def assign(name: str) -> str:
        return f"{word()} {name}{r.choice((' = ', '=', ': ', ':'))}"

    def mixed(low: int, high: int) -> str:
        """A password as people make them, or as a machine does."""
        if r.random() < 0.5:
            return "".join(r.choice(string.ascii_letters + string.digits + "!@#$%^&*-_+.~") for _ in range(r.randint(low, high))).strip("$%*") + r.choice(base64)
        return (r.choice((str.title, str.upper, str))(word() + word())[:9] + r.choice("!#_-@.") + draw("0123456789", 2, 4) + r.choice(("", "!", "x9")))[:high].ljust(low, "7")

    def issued() -> str:
        return r.choice((
            "ghp_" + draw(base64, 36, 36), "AKIA" + draw(string.ascii_uppercase + string.digits, 16, 16), "xoxb-" + draw("0123456789", 11, 12) + "-" + draw(base64, 24, 24),
            "sk-" + draw(base64, 32, 48), "AIza" + draw(base64 + "_-", 35, 35), "glpat-" + draw(base64 + "_-", 20, 20), "npm_" + draw(base64, 36, 36), "hf_" + draw(base64, 34, 34),
            "eyJ" + draw(base64, 17, 40) + ".eyJ" + draw(base64, 30, 90) + "." + draw(base64 + "_-", 30, 43),
        ))

    def opaque() -> str:
        value = r.choice((hexes(40), hexes(32), hexes(64), draw(base64, 20, 64), draw(base64 + "+/", 40, 88) + "=", draw(base64 + "_-", 24, 48), draw(string.ascii_letters, 20, 40)))
        return value.upper() if r.random() < 0.1 else value

    keys = ("token", "secret", "api_key", "password", "auth", "client_key", "access_key", "credential", "private_key", "passwd", "pwd", "apikey", "client-secret", "auth_token")
    out = []
    while len(out) < min(rows, FIT_ROWS):
        prose, more = f"{word()} {word()} ", f" {word()} {word()}"
        quote = r.choice(('"', '"', "'", ""))
        name = r.choice(keys)
        name = r.choice((name, name.upper(), f"{word()}_{name}", f"{word().upper()}_{name.upper()}"))
        if len(out) % 2:
            kind = r.randrange(10)
            if kind < 4:
                row = assign(name) + quote, opaque(), quote + more
            elif kind < 6:
                row = assign(name) + quote, mixed(8, 20), quote + more
            elif kind < 8:
                row = r.choice((prose, assign(name) + quote, f"{prose}{r.choice(('export ', ''))}{word().upper()}=", f"{prose}({quote}")), issued(), r.choice((more, ".", quote + more, ")"))
            elif kind == 8:
                row = f"{prose}{r.choice(('postgres', 'mysql', 'https', 'amqp', 'redis'))}://{word()}:", r.choice((mixed(8, 20), draw(base64, 10, 32))).replace("@", "a").replace("/", "b"), f"@{word()}.{word()}:{r.randint(1000, 9999)}/{word()}"
            else:
                row = f"{prose}Authorization: Bearer ", r.choice((opaque(), issued())), more
            out.append((*row, 1))
            continue
        number = str(r.randrange(10**15, 10**16))
        long_name = "_".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + str(r.randint(0, 99))
        uuid = "-".join((hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)))
        kind = r.choice((2, 2, *range(15)))
        if kind == 0:
            row = prose, number, more
        elif kind == 1:
            row = r.choice((prose, assign("id"), f"{prose}token id: ", f"{prose}request_id=", f"{word()} session id ", f'"{word()}_id": ')) + quote, uuid, quote + more
        elif kind == 2:
            said = f'{quote}{r.choice(("integrity", "checksum", "digest", "etag", "hash", "fingerprint", "revision", "trace", "cursor"))}{quote}{r.choice((": ", "=", " = "))}{quote}'
            said = r.choice((said, r.choice(("commit ", "sha256:", "sha1 ", "md5 ", "checksum ", "digest: ", "etag=", "revision ", "integrity: ", "hash "))))
            row = prose + said, r.choice((hexes(32), hexes(40), hexes(64), draw(base64 + "+/", 86, 86) + "==")), quote + more
            if r.random() < 0.6:  # the name of the digest is part of the run
                row = row[0], f"sha{r.choice((1, 256, 384, 512))}-{row[1]}", more
        elif kind == 3:
            row = r.choice((prose, assign("name"), assign(name))) + quote, long_name, quote + more
        elif kind == 4:
            row = f"{prose}{r.choice((f'https://{word()}.org/', f'/{word()}/', './', f'src/{word()}/'))}", "/".join((word(), word() + str(r.randint(1, 999)), word(), word(), "x" * 6)), r.choice((".html", ".png", "?a", ".js", ".py")) + more
        elif kind == 5:
            row = assign(name) + quote, r.choice(("x" * 20 + "1", "your_token_here_123", "0" * 32, "1234567890123456", "example_secret_000000", "test_api_key_12345678", "changeme", "password", "your-password", "********", "xxxxxxxx", "placeholder", "redacted")), quote + more
        elif kind == 6:
            row = prose, word() + word() + word() + word() + word() + str(r.randint(1, 9)), more
        elif kind == 7:
            row = prose, draw("0123456789", 16, 24), r.choice((",", ".", more))
        elif kind == 8:
            row = assign(name) + quote, r.choice(("$" + word().upper() + "_KEY", "%" + word().upper() + "_TOKEN%", "process.env." + word().upper() + "_KEY", "config." + word() + "." + word(), "os.environ.get", "self." + word() + "_" + word(), "get_" + word() + "_" + word())), quote + more
        elif kind == 9:
            row = f"{prose}{r.choice(keys)}: ", (word() + word() + word() + word() + word())[: r.randint(8, 14)].ljust(8, "e"), more
        elif kind == 10:
            row = f"{prose}{r.choice(keys)}: " + r.choice(("the ", "")), r.choice([w for w in DICTIONARY if len(w) >= 7]) + r.choice(("s", "ing", "ed", "er.")), more
        elif kind == 11:
            row = f"{prose}{r.choice(('postgres', 'mysql', 'https'))}://{word()}:", r.choice(("password", "$PASSWORD", "changeme", "xxxxxxxx", "********", "your-password")), f"@{word()}.{word()}/{word()}"
        elif kind == 12:
            row = f"{prose}data:image/png;base64,", draw(base64 + "+/", 60, 400), r.choice(("=", '"', ")")) + more
        elif kind == 13:
            row = prose + r.choice(("build ", "version ", "v", "img-", "id ", "ref ")), f"{r.randint(0, 99)}-{hexes(8)}-{word()}-{r.randint(100, 999)}-{word()}", more
        else:
            row = prose, f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}", more
        out.append((*row, 0))
    return out


def grow(x: np.ndarray, y: np.ndarray, draw: np.random.Generator, level: int = LEVELS) -> float | tuple:
    """A tree as (feature, threshold, left, right), leaves as the share of label 1."""
    if not level or len(y) < 8 or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in draw.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n = cut + 1
        p, q = ones[cut] / n, (ones[-1] - ones[cut]) / (len(y) - n)
        impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0]:
            best = impurity[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    _, f, t = best
    left = x[:, f] <= t
    return int(f), float(t), grow(x[left], y[left], draw, level - 1), grow(x[~left], y[~left], draw, level - 1)


def fit_forest(spark: SparkSession, findings: list[tuple[str, str, str, int]], trees: int = TREES, seed: int = 8) -> list:
    """Trees grown on bootstrap samples of labelled findings, features taken by the scan's own expressions."""
    rows = spark.createDataFrame(findings[:FIT_ROWS], "before string, candidate string, after string, label int")
    names = [f"f_{n}" for n in FEATURES]
    data = np.array([tuple(r) for r in with_features(rows).select(*names, "label").collect()], float)
    x, y = data[:, :-1], data[:, -1]
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = draw.integers(0, len(y), len(y))
        out.append(grow(x[pick], y[pick], draw))
    return out


def tree_sql(tree: float | tuple, names: list[str]) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, t, left, right = tree
    return f"CASE WHEN f_{names[f]} <= {t!r}D THEN {tree_sql(left, names)} ELSE {tree_sql(right, names)} END"


def scan(docs: DataFrame, forest: list, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate: doc_id, ordinal, candidate, before, after, score, is_secret."""
    names = list(FEATURES)
    rows = with_features(candidates(docs))
    total = " + ".join(f"({tree_sql(t, names)})" for t in forest)
    return rows.withColumn("score", F.expr(f"({total}) / {len(forest)}")).select(
        "doc_id", "ordinal", "candidate", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret")
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), fit_forest(spark, example_findings()))
