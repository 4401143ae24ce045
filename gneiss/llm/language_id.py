"""Operator 4: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator seeded by its code
point. A trigram is bound by multiplying its letters' vectors, the first rotated by two
places and the second by one; a text is the sum (bundle) of its trigrams. Every language
has a prototype, the sum of its training texts' unit vectors, and a text takes the language
whose prototype has the highest cosine.

Letters are lower-cased; every run of other characters is one space, and a text has a space
before and after it. Null, empty or letterless texts are ``und`` with score 0. Ties go to
the first language by name. The score is the cosine, cut to 0..1."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import col, expand_rows, id_remainder, map_rows

DIM = 1024
#: Training texts, about evenly spread over the languages, that prototypes are fitted on at most.
MAX_TRAIN = 12_000
#: Languages that can be learned; more distinct labels are an error, not a cut.
MAX_LANGS = 2_000
_SPACE, _NARROW, _COLUMNS, _CHARS = 32, 128, 24_000, 600_000


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


class Encoder:
    """Bundled trigram vectors of texts."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letter = _letters()
        self.reset()

    def reset(self):
        self.symbol = np.full(0x110000, -1, np.int32)
        self.points: list[int] = []
        self.vectors = np.zeros((0, self.dim), np.int8)
        self.narrow = np.full(_NARROW**3, -1, np.int32)
        self.wide: dict[int, int] = {}
        self.bound = np.zeros((0, self.dim), np.float32)
        self.used = 0

    def _learn_symbols(self, points: np.ndarray) -> None:
        for p in points.tolist():
            self.symbol[p] = len(self.points)
            self.points.append(p)
            sign = np.random.Generator(np.random.PCG64(p + 1)).integers(0, 2, self.dim, dtype=np.int8)
            self.vectors = np.vstack([self.vectors, (sign * 2 - 1)[None]])

    def _columns(self, a, b, c) -> np.ndarray:
        """The column of each trigram in the table of bound vectors."""
        if len(self.points) <= _NARROW:
            key = (a * _NARROW + b) * _NARROW + c
            at = self.narrow[key]
            if (at < 0).any():
                new = np.unique(key[at < 0])
                self.narrow[new] = self._bind(new // _NARROW**2, new // _NARROW % _NARROW, new % _NARROW)
                at = self.narrow[key]
            return at
        key = (a.astype(np.int64) << 42) | (b.astype(np.int64) << 21) | c
        keys, back = np.unique(key, return_inverse=True)
        new = np.array([k for k in keys.tolist() if k not in self.wide], np.int64)
        if len(new):
            mask = (1 << 21) - 1
            self.wide.update(zip(new.tolist(), self._bind(new >> 42, new >> 21 & mask, new & mask).tolist(), strict=True))
        return np.fromiter((self.wide[k] for k in keys.tolist()), np.int64, len(keys))[back]

    def _bind(self, a, b, c) -> np.ndarray:
        v = np.roll(self.vectors[a], 2, axis=1) * np.roll(self.vectors[b], 1, axis=1) * self.vectors[c]
        if self.used + len(v) > len(self.bound):
            room = np.zeros((max(4096, self.used + len(v), 3 * len(self.bound) // 2), self.dim), np.float32)
            room[: self.used] = self.bound[: self.used]
            self.bound = room
        self.bound[self.used : self.used + len(v)] = v
        self.used += len(v)
        return np.arange(self.used - len(v), self.used)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A vector per text, and whether the text has a letter."""
        out, has = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size > _CHARS or i + 1 == len(texts):
                out[first : i + 1], has[first : i + 1] = self._encode(texts[first : i + 1])
                first, size = i + 1, 0
        return out, has

    def _encode(self, texts):
        if self.used > _COLUMNS:
            self.reset()
        n = len(texts)
        low = [" " + (t or "").lower() + " " for t in texts]
        data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.fromiter(map(len, low), np.int64, n))
        letter = self.letter[data]
        point = np.where(letter, data, _SPACE)
        # The runs of spaces between two texts stay apart, so that both have their own edge.
        stay = letter.copy()
        stay[0] = True
        stay[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
        point, doc, letter = point[stay], doc[stay], letter[stay]
        has = np.bincount(doc[letter], minlength=n) > 0
        symbol = self.symbol[point]
        if (symbol < 0).any():
            self._learn_symbols(np.unique(point[symbol < 0]))
            symbol = self.symbol[point]
        whole = (doc[2:] == doc[:-2])
        column = self._columns(symbol[:-2][whole], symbol[1:-1][whole], symbol[2:][whole])
        row = doc[2:][whole].astype(np.int64)
        out = np.empty((n, self.dim), np.float32)
        k = max(1, self.used)
        bound = self.bound[:k] if self.used else np.zeros((1, self.dim), np.float32)
        for at in range(0, n, 64):
            lo, hi = np.searchsorted(row, [at, at + 64])
            m = min(64, n - at)
            counts = np.bincount((row[lo:hi] - at) * k + column[lo:hi], minlength=m * k).reshape(m, k)
            out[at : at + m] = counts.astype(np.float32) @ bound
        return out, has


@dataclass
class Profiles:
    """Learned prototypes: unit rows, one per language, in the order of the names."""

    langs: list[str]
    vectors: np.ndarray
    dim: int = DIM


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Sums:
    def __init__(self, dim):
        self.encoder, self.dim, self.sums = Encoder(dim), dim, {}

    def __call__(self, langs, texts):
        v, has = self.encoder.encode(texts)
        v = _unit(v)
        for name in set(langs):
            pick = np.array([x == name for x in langs]) & has
            self.sums[name] = self.sums.get(name, np.zeros(self.dim)) + v[pick].sum(axis=0)
        return [], []

    def finish(self):
        return list(self.sums), [x.tolist() for x in self.sums.values()]


def fit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    max_train: int = MAX_TRAIN,
    dim: int = DIM,
) -> Profiles:
    """Prototypes from the labelled rows of ``df``. At most about ``max_train`` texts are used,
    picked by a hash of the key, the same share of ``max_train`` for every language; no labelled
    row gives an empty model, which calls everything ``und``."""
    lang = col(lang_col)
    labelled = df.filter(lang.isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} distinct languages to learn")
    if not counts:
        return Profiles([], np.zeros((0, dim), np.float32), dim)
    each = max_train / len(counts)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))]), lang)
    draw = (F.xxhash64(col(key_col), F.lit("lang")).bitwiseAND(0xFFFFFF) / float(1 << 24))
    rows = labelled.filter(draw < share).select(lang.alias("l"), col(text_col).alias("t")).repartition(8)
    fields = [T.StructField("l", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType()))]
    sums: dict[str, np.ndarray] = {k: np.zeros(dim) for k in counts}
    for name, v in expand_rows(rows, ["l", "t"], fields, lambda: _Sums(dim)).collect():
        sums[name] += np.array(v)
    langs = sorted(sums)
    return Profiles(langs, _unit(np.array([sums[k] for k in langs], np.float32)), dim)


def predict(
    df: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` with lang_pred and score."""
    model = df.sparkSession.sparkContext.broadcast(profiles)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def factory():
        m = model.value
        encoder = Encoder(m.dim)

        def fn(texts):
            if not m.langs:
                return ["und"] * len(texts), [0.0] * len(texts)
            v, has = encoder.encode(texts)
            cos = _unit(v) @ m.vectors.T
            best = cos.argmax(axis=1)
            score = np.clip(cos[np.arange(len(texts)), best], 0.0, 1.0).astype(np.float64)
            return [m.langs[b] if h else "und" for b, h in zip(best, has)], np.where(has, score, 0.0)

        return fn

    return map_rows(df, [text_col], keep, fields, factory)


def training_fold(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that prototypes may be learned from."""
    return df.filter(id_remainder(id_col, 4) != 2)
