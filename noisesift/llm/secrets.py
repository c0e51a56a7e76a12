"""Secret scan: base patterns plus a linear-chain conditional random field.

Base spans come from three fixed patterns. The field tags every word of a text as
secret-begin (B), inside (I) or outside (O) from the word's shape, its
neighbouring words, the quotes around it and a feature of the whole file, and is
decoded by Viterbi. Words that no stretch of B and I with a positive gain over O can
hold (by the running sums of an upper bound) are O in the best tagging, so the chain
falls into short runs and their decoding is that of the whole text. Spans of B I*
that touch no base span are added as kind ``crf``.

Training data: the ``SAMPLE_DOCS`` documents of smallest id hash (a documented
bound) in pieces of ``PIECE`` words, at most ``PIECES`` with a telling word and as
many without, labelled by the base patterns, plus secrets of other make (generated
by rule, with and without digits) in made-up lines, so the field learns what lies
beyond the patterns. The sample and the weights are all that is on the driver.

Defined results: null text counts as empty; an empty text has no spans and the
hash of the empty string; repeated rows are scanned once each; offsets are code
points, end exclusive.
"""

from __future__ import annotations

import bisect
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import hashed_sample, query, table

SAMPLE_DOCS = 2000
SYNTHETIC = 7000
PIECE, PIECES = 12, 4000
KINDS = ("assign", "access", "hex", "crf")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'`*%&$#()[]{}<>,;:!?.|"
_ALPHABET = frozenset(string.ascii_letters + string.digits + "+/_=.-")
_DIGIT, _ASCII_DIGIT = re.compile(r"\d"), re.compile("[0-9]")
_HINT = re.compile(
    r"pass(?!ag|eng|ion|iv|port\b|ed\b|es\b|ing\b)|pwd|secret(?!ar)|token|(?<!mon)(?<!tur)(?<!don)(?<!joc)(?<!whis)key(?!word|board|note)"
    r"|auth(?!or(?!i[sz])|entic)|bearer|credential", re.IGNORECASE)  # fmt: skip
# classes of bytes: digit, lower, upper, symbol, other
_CLASSES = bytes(ord("d" if c in string.digits else "l" if c in string.ascii_lowercase else "u" if c in string.ascii_uppercase else "s" if c in "+/_=.-" else "o") for c in map(chr, range(256)))
# names of things that look random and are no secrets
_IDS = frozenset(("commit", "revision", "rev", "sha", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "ref", "etag", "integrity", "iban", "fingerprint", "build", "version"))
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_HEXID = re.compile(r"[0-9a-f]{7,31}")
_CONTENT = re.compile(r"(sha(1|256|384|512)|md5)[-:]", re.IGNORECASE)
_URL_LOGIN = re.compile(r"://[^/:@?#]*:([^@/]+)@")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}", re.IGNORECASE)
_HEXED = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(" ") for i in range(256))

B, I, O = 0, 1, 2  # noqa: E741
N_LENGTH = 4  # under 8, under 12, under 16, longer
N_SHAPE, N_PREV, N_NEXT, N_FILE, N_COARSE, N_MIX, N_QUOTE = 7 * 2 * 2 * 2 * 2 * 2 * 5, 7, 3, 4, 13, 16 * N_LENGTH, 3
_SIZES = (N_SHAPE, N_PREV, N_PREV, N_NEXT, N_FILE, N_COARSE, N_COARSE * N_PREV, N_MIX, N_MIX * N_PREV, 2 * N_LENGTH * N_PREV * N_PREV, N_LENGTH * N_QUOTE)
_OFFSETS = [int(x) for x in np.cumsum([0, *_SIZES])]
N_FEATURES = _OFFSETS[-1]
QUOTED = 12  # words within one pair of quotes


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = raw.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if raw.translate(_HEXED).find(b"h" * 32) >= 0:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _shape(core: str) -> tuple[int, int]:
    """Index of a word's shape, and of its mix of letters."""
    n = len(core)
    length = bisect.bisect_right((4, 8, 12, 16, 20, 32), n)
    made = core.encode().translate(_CLASSES)
    digits = made.count(b"d")
    hexed = not core.strip("0123456789abcdefABCDEF")
    share = 1 + min(3, 4 * digits // max(1, n)) if digits else 0
    index = length
    for x in (b"u" in made, b"l" in made, b"s" in made, b"o" in made, hexed):
        index = index * 2 + int(x)
    mix = (_LENGTH[length] * 4 + bisect.bisect_right((1, 2, 4), made.count(b"lu"))) * 2 + int(_CONSONANTS.search(core) is not None)
    return index * 5 + share, mix * 2 + int(digits == 0)


_LENGTH = (0, 0, 1, 2, 3, 3, 3)


def _form(word: str, core: str) -> int:
    """Forms of words that look random by their make: 1 UUID, 2 account number, 3 link, 4 short hex id, 5 content hash; else 0."""
    if "://" in word or word.startswith("www."):
        return 0 if _URL_LOGIN.search(word) else 3
    if len(core) < 7:
        return 0
    if _CONTENT.search(word):
        return 5
    if _HEXID.fullmatch(core):
        return 4 if _ASCII_DIGIT.search(core) else 0
    if _UUID.fullmatch(core):
        return 1
    return 2 if _IBAN.fullmatch(core) and 5 * len(_ASCII_DIGIT.findall(core)) >= 3 * len(core) else 0


def _prev_class(word: str) -> int:
    if not word:
        return 0
    signed = word[-1] in "=:" or word in ("=>", "->")
    if _HINT.search(word):
        return 5 if signed else 1
    if word.strip("=:#\"'(").lower() in _IDS:
        return 6
    if signed:
        return 2
    return 3 if _DIGIT.search(word) else 4


def _place(word: str) -> tuple[int, int, int]:
    """Place and length of a word's core, and the class of a name written before it (-1: none)."""
    if (login := _URL_LOGIN.search(word)) is not None:  # a password in an address, as if it had a name
        return login.start(1), len(login[1]), 5
    core = word.strip(_TRIM)
    own = -1
    # "key=value" in one word: the name before the sign is the neighbour
    cut = max(core.rfind("="), core.rfind(":"))
    if 0 < cut < len(core) - 4 and (name := core[:cut].rstrip("=:\"'")) and not _DIGIT.search(name):
        own = _prev_class(core[: cut + 1])
        core = core[cut + 1 :].strip(_TRIM)
    return word.rfind(core) if core else 0, len(core), own


class Facts:
    """What words alone tell, one row a word: shape, mix, class as a neighbour, class of a name written
    before the core, digits as seen by the word before, any ASCII digit, opens a quote, closes one, form."""

    ROWS, CHARS = 1 << 18, 1 << 23

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((self.ROWS, 9), dtype=np.int16)
        self.chars = 0

    def of(self, words: list[str]) -> np.ndarray:
        ids = [self.ids.get(x, -1) for x in words]
        if -1 in ids:
            if self.chars > self.CHARS or len(self.ids) + len(words) > len(self.rows):
                self.__init__()
                if len(words) > len(self.rows):
                    self.rows = np.zeros((len(words), 9), dtype=np.int16)
            new = [x for x in dict.fromkeys(words) if x not in self.ids]
            self.rows[len(self.ids) : len(self.ids) + len(new)] = [self.facts(x) for x in new]
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            ids = [self.ids[x] for x in words]
        return self.rows[ids].astype(np.int64)

    @staticmethod
    def facts(word: str) -> tuple:
        plain = word[:-1] if word[-1] in ".,;!?" else word
        if plain.isascii() and plain.isalpha():  # nothing to look for besides the shape
            seen = 1 if _HINT.search(word) else 6 if plain.lower() in _IDS else 4
            return *_shape(plain), seen, -1, 2, False, False, False, 0
        at, n, own = _place(word)
        opens = word[0] in "\"'" or (own >= 0 and at > 0 and word[at - 1] in "\"'")
        closes = word.rstrip(".,;:)]}")[-1:] in ("\"", "'") and (len(word) > 1 or not opens)
        digit = 1 if _DIGIT.search(word) else 2
        core = word[at : at + n]
        return *_shape(core), _prev_class(word), own, digit, _ASCII_DIGIT.search(word) is not None, opens, closes, _form(word, core)


ALL = tuple(range(len(_SIZES)))
FOLDED = (0, 3, 4, 6, 8, 9, 10)  # what is left when weights of a word alone are added to those of its pairs


def folded(w: np.ndarray) -> np.ndarray:
    """Weights for the ``FOLDED`` columns that give the sums of all columns."""
    part = [w[a:b] for a, b in zip(_OFFSETS[:-1], _OFFSETS[1:], strict=True)]
    out = w.copy()
    out[_OFFSETS[6] : _OFFSETS[7]] += np.repeat(part[5], N_PREV, axis=0)
    out[_OFFSETS[8] : _OFFSETS[9]] += np.repeat(part[7], N_PREV, axis=0)
    out[_OFFSETS[9] : _OFFSETS[10]] += np.repeat(part[1], N_PREV * N_LENGTH * 2, axis=0) + np.tile(np.repeat(part[2], N_LENGTH * 2, axis=0), (N_PREV, 1))
    return out


def features(text: str, facts: Facts, columns: tuple[int, ...] = ALL) -> np.ndarray:
    """Indices of the features of each word of a text: words x features."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros((0, len(columns)), dtype=np.int64)
    shape, mix, as_prev, own, digit, ascii_digit, opens, closes, form = facts.of(words).T
    filed = bisect.bisect_right((0.01, 0.05, 0.2), int(ascii_digit.sum()) / (text.count(" ") + 1))
    before = np.concatenate(([0, 0], as_prev))
    named = own >= 0
    p1, p2 = np.where(named, own, before[1:-1]), np.where(named, before[1:-1], before[:-2])
    nxt = np.concatenate((digit[1:], [0]))
    quote = np.zeros(len(words), dtype=np.int64)
    after = -1
    for k in np.flatnonzero(opens):
        if k > after:  # up to the closing quote, or for a few words if there is none
            shut = np.flatnonzero(closes[k : k + QUOTED])
            after = k + int(shut[0]) if len(shut) else k
            quote[k : after + 1] = 2 if p1[k] == 5 or (p1[k] == 2 and p2[k] in (1, 5)) else 1
            if words[k] in "\"'":  # a quote set off by a space belongs to what follows
                quote[k] = 0
    flags, length = shape // 5 % 32, np.array(_LENGTH)[shape // 160]
    coarse = np.where(form > 0, 7 + form, 4 * (length == 3) + 2 * ((flags & 24) > 0) + ((flags & 6) > 0))
    context = ((p1 * N_PREV + p2) * N_LENGTH + length) * 2 + mix % 2
    every = (shape, p1, p2, nxt, np.full(len(words), filed), coarse, coarse * N_PREV + p1, mix, mix * N_PREV + p1, context, length * N_QUOTE + quote)
    return np.stack([every[c] + _OFFSETS[c] for c in columns], axis=1)


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word's core."""
    out = []
    for m in _WORD.finditer(text):
        at, n, _ = _place(m[0])
        out.append((m.start() + at, m.start() + at + n))
    return out


def _forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Log partition, unary and pairwise marginals of padded runs; before and after a run stands O."""
    n, width, _ = emit.shape
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = trans[O] + emit[:, 0]
    for t in range(1, width):
        s = alpha[:, t - 1, :, None] + trans[None]
        top = s.max(axis=1)
        step = top + np.log(np.exp(s - top[:, None]).sum(axis=1)) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    z = alpha[:, -1] + trans[:, O]
    top = z.max(axis=1)
    z = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
    beta[:, -1] = trans[:, O]
    for t in range(width - 2, -1, -1):
        s = trans[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
        top = s.max(axis=2)
        step = top + np.log(np.exp(s - top[..., None]).sum(axis=2))
        beta[:, t] = np.where(mask[:, t + 1, None], step, trans[:, O])
    unary = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[..., None]
    pair = np.zeros((3, 3))
    pair[O] += unary[:, 0].sum(axis=0)
    last = mask.sum(axis=1) - 1
    pair[:, O] += unary[np.arange(n), last].sum(axis=0)
    for t in range(1, width):
        p = np.exp(np.minimum(alpha[:, t - 1, :, None] + trans[None] + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None], 0))
        pair += (p * mask[:, t, None, None]).sum(axis=0)
    return z, unary, pair


FORBIDDEN = np.zeros((3, 3))
FORBIDDEN[O, I] = -1e4


def fit(runs: list[list[list[int]]], tags: list[list[int]], steps: int = 200, batch: int = 1600, rate: float = 0.3, decay: float = 1e-3):
    """Maximum-likelihood weights of the field by AdaGrad on batches of runs, dealt anew each pass: (features x 3, 3 x 3)."""
    w, trans = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    w[:, O] = 0.01
    if not runs:
        return w, trans + FORBIDDEN
    width = max(map(len, runs))
    n_feat = len(runs[0][0])
    feats = np.zeros((len(runs), width, n_feat), dtype=np.int64)
    mask = np.zeros((len(runs), width), dtype=bool)
    gold = np.zeros((len(runs), width, 3))
    gold_pair = np.zeros((len(runs), 3, 3))
    for k, (r, g) in enumerate(zip(runs, tags, strict=True)):
        feats[k, : len(r)], mask[k, : len(r)] = r, True
        gold[k, np.arange(len(r)), g] = 1
        for a, b in zip([O, *g], [*g, O], strict=True):
            gold_pair[k, a, b] += 1
    rng, order = np.random.default_rng(3), np.zeros(0, dtype=np.int64)
    g2w, g2t = np.full_like(w, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(steps):
        if not len(order):
            order = rng.permutation(len(runs))
        now, order = order[:batch], order[batch:]
        here = mask[now]
        emit = np.zeros((len(now), width, 3))
        words = feats[now][here]
        emit[here] = w[words].sum(axis=1)
        _, unary, pair = _forward_backward(emit, here, trans + FORBIDDEN)
        miss = (gold[now][here] - unary[here]) / len(now)
        grad = np.zeros_like(w)
        for tag in range(3):
            grad[:, tag] = np.bincount(words.ravel(), weights=np.repeat(miss[:, tag], n_feat), minlength=N_FEATURES)
        grad -= decay * w
        grad_t = (gold_pair[now].sum(axis=0) - pair) / len(now) - decay * trans
        g2w += grad**2
        g2t += grad_t**2
        w += rate * grad / np.sqrt(g2w)
        trans += rate * grad_t / np.sqrt(g2t)
    return w, trans + FORBIDDEN


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best tags of one run; before and after it stands O."""
    score, back = trans[O] + emit[0], []
    for e in emit[1:]:
        s = score[:, None] + trans
        back.append(s.argmax(axis=0))
        score = s.max(axis=0) + e
    tag = int((score + trans[:, O]).argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]


_ID_LEADS = ("commit", "revision", "sha", "checksum:", "id:", "uuid", "ref", "hash", "digest:", "build", "in commit", "IBAN", "iban:", "request id", "account")


def _synthetic(rng: np.random.Generator) -> tuple[str, int, int]:
    """A made-up line, and the place of the secret in it (an empty one: none)."""

    quick = random.Random(int(rng.integers(0, 1 << 60)))

    def take(alphabet: str, n: int) -> str:
        return "".join(quick.choices(alphabet, k=int(n)))

    def pick(*of):
        return of[int(rng.integers(0, len(of)))]

    def plain_word() -> str:
        w = "".join(take("bcdfglmnprstvw", 1) + take("aeiou", 1) + (take("lnrst", 1) if rng.random() < 0.3 else "") for _ in range(int(rng.integers(1, 5))))
        how = rng.random()
        return w.capitalize() if how < 0.15 else w.upper() if how < 0.18 else pick("the", "of", "and", "is", "a", "in", "to") if how < 0.4 else w

    def phrase(n: int) -> list[str]:
        return [take("bcdfglmnprstvw", 1) + take("aeiou", 1) + take("bcdglmnprst", 1) + take("aeiou", 1) + take("lnrst", int(rng.integers(0, 2))) for _ in range(n)]

    letters, lower, hexes = string.ascii_letters, string.ascii_lowercase, "0123456789abcdef"

    def uuid() -> str:
        return "-".join(take(hexes, n) for n in (8, 4, 4, 4, 12))

    mixed = letters + string.digits * pick(0, 0, 1, 1, 3)
    kind = int(rng.integers(0, 35))
    hints = ("key", "auth", "credential =", "bearer", "secret:", "pwd =", "Authorization: Bearer", "passphrase:", "token =", "pass:")
    signed = tuple(h for h in hints if h[-1] in "=:")
    secret = {
        0: lambda: pick("ghp_", "xoxb-", "glpat-") + take(mixed, 36),
        1: lambda: "sk_live_" + take(mixed, 24),
        2: lambda: take(mixed + "+/", 40),
        3: lambda: "eyJ" + take(mixed, 20) + "." + take(mixed, 40) + "." + take(mixed, 28),
        4: lambda: take("abcdef" if mixed == letters else string.hexdigits[:16], 25),
        14: lambda: take(mixed, int(rng.integers(12, 33))),
        15: lambda: take(mixed, int(rng.integers(10, 25))),  # after a hint
        16: lambda: pick("", "-", "_", ".").join(phrase(int(rng.integers(2, 6)))),  # after a hint with a sign
        17: lambda: take(pick(lower, letters, letters), int(rng.integers(16, 41))),  # after a hint
    }
    plain = {
        5: lambda: take(string.digits, int(rng.integers(1, 17))),
        6: lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        7: lambda: f"{take(lower, 5)}.{pick(str(rng.integers(0, 99)), take(lower, 4))}@{take(lower, 6)}.example.com",
        8: lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        9: lambda: take(lower, int(rng.integers(3, 12))) + str(rng.integers(0, 100)),
        10: lambda: f"({rng.integers(100, 1000)}) {rng.integers(100, 1000)}-{rng.integers(1000, 10000)}",
        11: lambda: " ".join(str(rng.integers(1000, 10000)) for _ in range(int(rng.integers(2, 5)))),
        12: lambda: f"{rng.integers(0, 100)} {rng.integers(0, 100)}.{rng.integers(0, 10)}",
        13: lambda: f"{take(lower, 6)}{rng.integers(0, 10)}-{take(lower, 4)} {rng.integers(0, 1000)}{take(lower, 2)}",
        18: lambda: " ".join(plain_word() for _ in range(int(rng.integers(1, 6)))),
        19: lambda: pick("https://www.", "www.", "/usr/", "src/", "") + pick(".", "/", "_", "-").join(phrase(int(rng.integers(2, 6)))) + pick("", ".html", ".py", "()"),
        20: lambda: "".join(w.capitalize() for w in phrase(int(rng.integers(2, 4)))),
        21: lambda: " ".join(plain_word() + pick("", ",", ".", ":", "-" + plain_word(), "'s") for _ in range(int(rng.integers(2, 9)))),
    }
    plain |= {
        22: lambda: " ".join([pick(str.lower, str.capitalize)("".join(phrase(int(rng.integers(2, 6)))) + take("cdhnrst", int(rng.integers(0, 5))) + take("aeiou", 1))] * pick(1, 1, 4)),
        23: lambda: " ".join(plain_word() + pick("$$$", "%%%", "&&&", "***", "###", ".", ";") for _ in range(int(rng.integers(2, 9)))),
        24: lambda: pick(".\n", ". ", "/", "-").join("".join(phrase(2)).capitalize() for _ in range(2)),
    }
    secret |= {
        25: lambda: take(pick(lower, mixed, letters + string.digits + "!%$*-_"), int(rng.integers(8, 25))),  # in an address
        26: lambda: take(pick(lower, lower, letters), int(rng.integers(10, 21))),  # after a name and "is", or a sign
        27: lambda: pick(uuid, lambda: take(hexes, int(rng.integers(16, 32))))(),  # after a hint with a sign
    }
    plain |= {
        28: uuid,
        29: lambda: take(hexes, int(rng.integers(7, 32))),
        30: lambda: take(string.ascii_uppercase, 2) + take(string.digits, 2) + pick("", take(string.ascii_uppercase, 4)) + take(string.digits, int(rng.integers(11, 20))),
        31: lambda: pick("https://", "https://www.", "http://") + plain_word().lower() + pick(".com/", ".org/", ".be/", ".net/") + pick("watch?v=", "?id=", "?q=", "embed/", "v/", "p/", "d/", "item?t=", "") + take(mixed + "-_", int(rng.integers(8, 25))),
        32: lambda: plain_word(),  # after a name and "is"
        33: lambda: pick("sha256-", "sha512-", "sha384-", "sha256:") + take(letters + string.digits + "+/", 43) + pick("", "="),
        34: lambda: pick("https://", "http://") + plain_word().lower() + ".com/" + "/".join(phrase(int(rng.integers(1, 4)))) + pick("", "?page=2", "#top", "?lang=en"),
    }
    before, after = ([plain_word() for _ in range(int(rng.integers(0, 4)))] for _ in range(2))
    body = secret[kind]() if kind in secret else plain[kind]()
    pre, post = "", ""
    if kind in (16, 27):
        lead = pick(*signed)
    elif kind in (4, 15, 17):
        lead = pick(*hints)
    elif kind == 25:
        lead = pick(plain_word(), plain_word(), "url:", "url =", "at", "from", "")
        pre = pick("postgres", "postgresql", "mysql", "mongodb", "redis", "amqp", "https", "ftp") + "://" + pick("", plain_word().lower()) + ":"
        post = "@" + plain_word().lower() + pick("", ".example.com", ".internal") + pick("", ":" + str(rng.integers(1000, 9999))) + pick("", "/" + plain_word().lower())
    elif kind in (26, 32):
        lead = pick("the passphrase is", "my password is", "the pwd is", "password is", "its secret is", "the pass phrase is", *(("passphrase:", "pwd:", "passphrase =", "pass:") if kind == 26 else ()))
    elif kind in (28, 29, 30, 33):
        lead = pick(*_ID_LEADS, *[plain_word() for _ in range(8)])
    elif kind in (31, 34):
        lead = pick("see", "at", "link:", "video:", "from", plain_word(), plain_word())
    elif kind >= 18:  # words of which few are names of secrets; with a sign, short ones only follow
        lead = pick("key", "auth", "bearer", "secret", "token", "password", "Name:", "see", "Note:", *_ID_LEADS[:4], plain_word(), plain_word(), plain_word())
    else:
        lead = pick(*hints, *[plain_word() for _ in range(8)])
    quote = '"' if rng.random() < 0.3 and kind != 26 else ""
    if kind == 16 and quote and rng.random() < 0.5:
        body = " ".join(phrase(int(rng.integers(2, 6))))
    elif kind in secret and kind not in (16, 25, 26, 27) and rng.random() < 0.25:  # a secret wrapped over two words
        half = len(body) // 2
        body = f"{body[:half]} {body[half:]}"
    start = " ".join([*before, lead, quote])
    start = start if quote else start.rstrip() + " "
    end = pick("", ".", ",") if not quote else ""
    start += pre
    return f"{start}{body}{post}{quote}{end} {' '.join(after)}.", len(start), len(start) + len(body) if kind in secret else len(start)


def _tagged(text: str, spans: list[tuple[int, int]], facts: Facts) -> tuple[np.ndarray, list[int]]:
    feats = features(text, facts)
    if not spans:
        return feats, [O] * len(feats)
    hit = [next((s for s in spans if s[0] < e and b < s[1]), None) for b, e in places(text)]
    return feats, [O if h is None else I if k and hit[k - 1] is h else B for k, h in enumerate(hit)]


def _values(text: str) -> list[tuple[int, int]]:
    """The values of the base spans, without the names before them."""
    out = []
    for kind, b, e in base_spans(text, text.encode()):
        out.append((ASSIGN.match(text, b).start(2) if kind == "assign" else b, e))
    return out


def training_set(texts: list[str]) -> tuple[list, list]:
    """Runs and tags: pieces of sampled texts labelled by the base patterns, and made-up lines."""
    rng, facts = np.random.default_rng(11), Facts()
    lots: tuple[list, list] = ([], [])
    for t in texts:
        feats, tags = _tagged(t, _values(t), facts)
        told = (np.array(tags) != O) | ((feats[:, 0] % 5) > 0) | np.isin(feats[:, 1] - _OFFSETS[1], (1, 2, 3, 5))
        for k in range(0, len(tags), PIECE):
            lots[0 if told[k : k + PIECE].any() else 1].append((feats[k : k + PIECE], tags[k : k + PIECE]))
    kept = [lot[i] for lot in lots for i in sorted(rng.permutation(len(lot))[:PIECES])]
    for _ in range(SYNTHETIC):
        line, b, e = _synthetic(rng)
        feats, tags = _tagged(line, [(b, e)] if b < e else [], facts)
        kept += [(feats[k : k + PIECE], tags[k : k + PIECE]) for k in range(0, len(tags), PIECE)]
    # a piece that begins inside a secret begins it
    return [f.tolist() for f, _ in kept], [[B, *g[1:]] if g[0] == I else g for _, g in kept]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Weights of the field from the bounded sample of documents."""
    return fit(*training_set([r["t"] for r in hashed_sample(docs, SAMPLE_DOCS, id_col, text_col)]))


def ready(model: tuple) -> tuple:
    """The weights as ``all_spans`` takes them."""
    return folded(model[0]), model[1]


def open_words(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Whether a word can be B or I in the best tagging of the whole text."""
    gain, step = emit - emit[:, O, None], trans - trans[O, O]
    most = np.maximum(gain[:, B] + step[:, B].max(), gain[:, I] + step[[B, I], I].max())
    total = np.concatenate(([0.0], np.cumsum(most)))
    highest = np.maximum.accumulate(total[:0:-1])[::-1]
    return highest - np.minimum.accumulate(total[:-1]) + step[[B, I], O].max() > -1e-9


def all_spans(text: str, raw: bytes, model: tuple, facts: Facts | None = None) -> list[tuple[str, int, int]]:
    """Base spans and the field's further ones, by start and kind; the model is that of ``ready``."""
    w, trans = model
    spans = base_spans(text, raw)
    feats = features(text, facts or Facts(), FOLDED)
    found = []
    if len(feats):
        emit = w[feats].sum(axis=1)
        at = np.flatnonzero(open_words(emit, trans))
        where = places(text) if len(at) else []
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
            open_ = None
            for k, tag in zip([*run, -1], [*viterbi(emit[run], trans), O], strict=True):
                b, e = where[k]
                if open_ and tag != I:
                    found.append(("crf", *open_))
                    open_ = None
                if tag == B:
                    open_ = (b, e)
                elif tag == I and open_:
                    open_ = (open_[0], e)
    taken = sorted((b, e) for _, b, e in spans)
    extra = [s for s in found if s[1] < s[2] and not any(b < s[2] and s[1] < e for b, e in taken)]
    return sorted([*spans, *extra], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: spans as arrays of (kind, start, end); ``carry`` columns pass through."""
    if model is None:
        model = train(docs, id_col, text_col)
    model = ready(model)
    kept = [F.col(c) for c in carry]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema) if carry else ""

    def run(batches):
        facts = Facts()
        for b in batches:
            kinds = []
            texts = b.column(0)
            for t in texts:
                t = t.as_py() or ""
                kinds.append([{"kind": k, "start": x, "end": y} for k, x, y in all_spans(t, t.encode(), model, facts)])
            spans = pa.array(kinds, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], spans], names=[*carry, "_spans"])

    return docs.select(F.col(text_col).alias("_text"), *kept).mapInArrow(run, ddl + "_spans array<struct<kind:string,start:bigint,end:bigint>>")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of the text replaced by a mark; same columns."""
    names = docs.columns
    found = scan_secrets(docs, id_col=id_col, text_col=text_col, carry=tuple(names))
    pieces = F.expr(
        f"aggregate(_spans, named_struct('at', 0L, 'out', ''), (s, x) -> if(x.end <= s.at, s, named_struct("
        f"'at', x.end, 'out', concat(s.out, substring(`{text_col}`, int(s.at) + 1, int(greatest(x.start - s.at, 0L))), '{mark}'))), "
        f"s -> concat(s.out, substring(`{text_col}`, int(s.at) + 1)))"
    )
    return found.select(*[F.when(F.size("_spans") > 0, pieces).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in names])


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = scan_secrets(docs, carry=("doc_id",))
    base = F.filter("_spans", lambda x: x["kind"] != "crf")
    n = [F.expr(f"size(filter(_spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return s.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))
