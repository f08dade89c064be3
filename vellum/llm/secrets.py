"""Secret scans: fixed patterns, and strings that a tokenizer finds no words in.

Fixed kinds, each leftmost and non-overlapping: assign (a key word, : or =, and a value of 6 or more characters), access (AKIA and capitals and
digits, 20 or more characters) and hex (24 or more of 0-9a-f). The method adds kind random: strings of LEAST or more of A-Za-z0-9+/_=- that hold a
letter and give fewer than RATIO characters per token of a byte-level vocabulary, words and names giving more (fewer than ONE_CASE of that if all letters
are of one case, or all but the first, and there is no digit). Fixed spans are cut out of a run
first. What is left is tested whole; if it is not random, what lies between its words is, at / and =, and then at - _ and + too, so that words before
or after a key hide none. Left out are known digests: those that the caller names (known), and hexadecimal (in either case) or base64 values of a digest's
length after a name such as sha256, md5, checksum or integrity; and identifiers: UUIDs, ULIDs and 32 hexadecimal digits after a name that ends in id or is
guid, ulid, ref, request, trace or span, paths and other strings of words, dates, numbers with separators. Other identifiers that look random (KSUIDs,
nano ids, object ids in capitals) are found as random strings. Spans are code points, end exclusive. Shorter random strings are found in an assignment only.

Defined results: a null text is empty; an empty text has no spans; a text of any length is scanned whole; repeated rows get equal results;
an empty table gives an empty table; other columns pass through.
"""

import base64
import hashlib
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.arrow import batched, only
from vellum.llm.common import fresh, named

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Fewest characters of a random string; a part of a name of fewer than PART letters is no sign of a word or of its absence.
LEAST, PART = 16, 5
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
WORD = re.compile(rf"[A-Za-z]{{{PART},}}")
#: Characters that parts of a run lie between, in the order in which they are tried.
BETWEEN = (re.compile(r"[^/=]+"), re.compile(r"[^/=_+-]+"))
SIGN = re.compile(r"[/_=+-]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORDY = re.compile(r"[-_/]*(?:[A-Za-z]{2,}|[0-9]{1,4}|[A-Z][a-z]+)(?:[-_/]+(?:[A-Za-z]+|[0-9]{1,8}|[a-z]+[0-9]{1,4}))*[-_/]*")
NUMBER = re.compile(r"[0-9][0-9_/=+-]*")
BASE64 = "[A-Za-z0-9+/]"
#: Digests of 16, 20, 28, 32, 48 and 64 bytes, the longest first.
DIGEST = "|".join([f"[0-9A-Fa-f]{{{2 * n}}}|{BASE64}{{{-(-n * 4 // 3)}}}{'=' * (-n % 3)}" for n in (64, 48, 32, 28, 20, 16)])
BEYOND = r"(?![A-Za-z0-9+/_=-])"
KNOWN = (
    re.compile(rf"""(?<![A-Za-z])(?i:sha-?(?:1|224|256|384|512)|md5|blake2[bs]?|checksum|digest|commit|integrity|etag|fingerprint)(?i:sum)?["']?[^A-Za-z0-9\n]{{0,4}}({DIGEST}){BEYOND}"""),
    re.compile(rf"""(?<![A-Za-z])(?i:[a-z_]{{0,24}}id|guid|ulid|ref|request|trace|span)["']?[^A-Za-z0-9\n]{{0,4}}([0-7][0-9A-HJKMNP-TV-Z]{{25}}|[0-7][0-9a-hjkmnp-tv-z]{{25}}|[0-9A-Fa-f]{{32}}){BEYOND}"""),
)
RATIO = 2.2
#: Share of the ratio below which letters of one case, as words are, count as random: words of a language that the vocabulary does not know have about 2
#: characters a token, random letters 1.6 to 1.7.
ONE_CASE = 0.82
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FIELDS = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("n_random", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)
Span = tuple[int, int, int]


def encoding(vocabulary: str):
    """A tiktoken vocabulary from its file of ranks."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """(start, kind's place in KINDS, end) of the fixed kinds, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def chars_a_token(run: str, enc) -> float:
    return len(run) / max(1, len(enc.encode_ordinary(run)))


def is_known(text: str, start: int, end: int, enc, ratio: float = RATIO) -> bool:
    """Whether the string is an identifier, whose words have to be ones by the ratio if they are long enough to tell."""
    run = text[start:end]
    if UUID.fullmatch(run) or NUMBER.fullmatch(run):
        return True
    if WORDY.fullmatch(run):
        words = WORD.findall(run)
        n = sum(map(len, words))
        return n < LEAST or n >= ratio * sum(len(enc.encode_ordinary(w)) for w in words)
    return False


def is_random(text: str, start: int, end: int, enc, ratio: float) -> bool:
    run = text[start:end]
    if end - start < LEAST or not any(c.isalpha() for c in run) or not any(c.isdigit() for c in run) and len(set(run)) < 6:
        return False
    letters = SIGN.sub("", run)
    if letters.isalpha() and (letters[1:].islower() or letters.isupper()):
        ratio *= ONE_CASE
    return chars_a_token(run, enc) < ratio and not is_known(text, start, end, enc, ratio)


def random_parts(text: str, start: int, end: int, enc, ratio: float, level: int = 0) -> list[Span]:
    """Random strings in a run: all of it, or else stretches of its parts that are no words, or else single parts or what they hold."""
    if is_random(text, start, end, enc, ratio):
        return [(start, 3, end)]
    if level == len(BETWEEN) or end - start < LEAST or is_known(text, start, end, enc, ratio):
        return []
    out: list[Span] = []
    stretch: list[tuple[int, int]] = []

    def close() -> None:
        if stretch:
            a, b = stretch[0][0], stretch[-1][1]
            if is_random(text, a, b, enc, ratio):
                out.append((a, 3, b))
            else:
                for x, y in stretch:
                    out.extend(random_parts(text, x, y, enc, ratio, level + 1))
            stretch.clear()

    for m in BETWEEN[level].finditer(text, start, end):
        a, b = m.span()
        if is_known(text, a, b, enc, ratio):
            close()
        elif chars_a_token(m[0], enc) >= ratio:
            close()
            out.extend(random_parts(text, a, b, enc, ratio, level + 1))
        else:
            stretch.append((a, b))
    close()
    return out


def random_spans(text: str, taken: list[Span], enc, ratio: float = RATIO, known: frozenset[str] = frozenset()) -> list[Span]:
    """Spans of the kind random outside of taken; where there are any, known digests and identifiers are looked for and the rest is scanned again."""
    found = [m.span() for m in RUN.finditer(text)]

    def outside(none: list[tuple[int, int]]) -> list[Span]:
        out, i, reach = [], 0, 0
        for a, b in found:
            a = max(a, reach)
            while i < len(none) and none[i][0] < b:
                if none[i][0] - a >= LEAST:
                    out += random_parts(text, a, none[i][0], enc, ratio)
                reach, i = max(reach, none[i][1]), i + 1
                a = max(a, reach)
            if b - a >= LEAST:
                out += random_parts(text, a, b, enc, ratio)
        return out

    base = [(a, b) for a, _, b in taken]
    out = outside(base)
    if out and (named_ones := [m.span(1) for rule in KNOWN for m in rule.finditer(text)]):
        out = outside(sorted(base + named_ones))
    return [x for x in out if text[x[0] : x[2]].lower() not in known] if known else out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scanner(vocabulary: str, ratio: float, known: frozenset[str] = frozenset()) -> Callable[[], Callable[[list], list[tuple]]]:
    def make():
        enc = encoding(vocabulary)

        def scan(texts: list) -> list[tuple]:
            out = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, enc, ratio, known)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, len(more), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)))
            return out

        return scan

    return make


def scanned(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO, column: str = "text", known: Iterable[str] = ()) -> DataFrame:
    """docs with the counts of each kind, base_sha256 and spans. known: digests that are no secrets, in any case; they travel to every worker."""
    return batched(docs, scanner(vocabulary, ratio, frozenset(k.lower() for k in known)), column, FIELDS)


def redacted_text(text: str, spans: list[Span]) -> str:
    """text with each stretch covered by spans replaced by the name of its first kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in sorted(spans):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO, known: Iterable[str] = ()) -> DataFrame:
    """docs with the secrets of text replaced and n_chars, where there is such a column, counted anew; same columns."""

    few = frozenset(k.lower() for k in known)

    def make():
        enc = encoding(vocabulary)

        def run(texts: list) -> list[tuple]:
            out = []
            for text in texts:
                base = base_spans(text or "")
                spans = base + random_spans(text or "", base, enc, ratio, few)
                out.append((redacted_text(text, spans) if spans else None,))
            return out

        return run

    (new,) = fresh(docs, "redacted")
    out = batched(docs, make, "text", T.StructType([T.StructField(new, T.StringType())]))
    text = F.coalesce(named(new), named("text"))
    n = F.when(named(new).isNotNull(), F.length(named(new)).cast("long")) if "n_chars" in docs.columns else None
    columns = {"text": text} | ({"n_chars": F.coalesce(n, named("n_chars")).cast(docs.schema["n_chars"].dataType)} if n is not None else {})
    return out.select(*[columns[c].alias(c) if c in columns else named(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    return scanned(only(docs, "doc_id", "text")).drop("text")
