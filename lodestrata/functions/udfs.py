"""Functions that no built-in expresses, as Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Named scorers; a name is registered once.
REGISTRY: dict[str, Callable] = {}


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = f
        return f

    return add


def strip_accents():
    """string -> string: NFD without non-spacing marks."""

    @F.pandas_udf("string")
    def strip(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    return strip


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """string -> array<float>: the model is loaded once for each worker and gets whole Arrow batches. Null gives null."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for text in batches:
            known = text.dropna()
            out = pd.Series([None] * len(text), index=text.index, dtype=object)
            if len(known):
                out.loc[known.index] = pd.Series(list(model(known.tolist())), index=known.index, dtype=object)
            yield out

    return encode


def predictor(load: Callable[[], Callable[[list[str]], np.ndarray]], binary: bool, mean: float = 0.0, sd: float = 1.0):
    """string -> double: the sigmoid of the raw output, or the raw output scaled back."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for text in batches:
            raw = np.asarray(model(text.fillna("").tolist()), float).reshape(-1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -50, 50))) if binary else raw * sd + mean)

    return predict


@register("ngram-64")
def hashed_ngrams(texts: list[str], size: int = 64, n: int = 3) -> np.ndarray:
    """A stand-in encoder: counts of hashed character n-grams, scaled to length 1."""
    out = np.zeros((len(texts), size), np.float32)
    for row, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8).astype(np.uint64)
        if len(data) >= n:
            h = np.zeros(len(data) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + data[k : len(data) - n + 1 + k]
            out[row] = np.bincount(((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) % size, minlength=size)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


@register("length")
def lengths(texts: list[str]) -> np.ndarray:
    """A stand-in model: the number of code points over 1000."""
    return np.array([len(t) / 1000 for t in texts], float)


@register("lengths-2")
def length_pair(texts: list[str]) -> np.ndarray:
    """A stand-in encoder: code points and UTF-8 bytes."""
    return np.array([[len(t), len(t.encode())] for t in texts], np.float32).reshape(-1, 2)


def _linear_model(path: str) -> Callable[[list[str]], np.ndarray]:
    """A checkpoint of its own kind, JSON: `features` (named feature functions), `weights` and `bias`."""
    import json
    import posixpath

    from ..sources.matrix import store_of

    store, own = store_of(path)
    with store.open_input_stream(posixpath.normpath(own)) as f:
        model = json.loads(f.read())
    weights = np.array(model["weights"], float)
    return lambda texts: np.stack([np.array([FEATURES[n](t) for t in texts], float) for n in model["features"]], 1).reshape(-1, len(weights)) @ weights + model["bias"]


def _onnx_model(path: str) -> Callable[[list[str]], np.ndarray]:
    """An ONNX graph from strings to numbers, where onnxruntime is installed."""
    import onnxruntime

    from ..sources.matrix import store_of

    store, own = store_of(path)
    with store.open_input_stream(own) as f:
        session = onnxruntime.InferenceSession(f.read())
    return lambda texts: np.asarray(session.run(None, {session.get_inputs()[0].name: np.array(texts, object)})[0], float).reshape(len(texts), -1)[:, 0]


#: Features that a linear checkpoint may name.
FEATURES: dict[str, Callable[[str], float]] = {"length": len, "words": lambda t: len(t.split()), "digits": lambda t: sum(c.isdigit() for c in t)}
#: Loaders by suffix; `register(".suffix")` adds others.
LOADERS: dict[str, Callable[[str], Callable]] = {".json": _linear_model, ".onnx": _onnx_model}


def scorer(path: str, binary: bool, mean: float = 0.0, sd: float = 1.0):
    """string -> double by the kind of model file: `.model` names a registered scorer, `.json` is a linear checkpoint, `.onnx` a
    graph; other kinds need a loader of their own, registered under their suffix. The file is loaded once for each worker."""
    name, _, suffix = path.rpartition("/")[2].rpartition(".")
    if suffix == "model":
        return predictor(lambda: REGISTRY[name], binary, mean, sd)
    load = LOADERS.get(f".{suffix}") or REGISTRY.get(f".{suffix}")
    if load is None:
        raise ValueError(f"no scorer for .{suffix} files")
    return predictor(lambda: load(path), binary, mean, sd)


def ngram_encoder():
    return encoder(lambda: hashed_ngrams)


def within_ulp():
    """(double, double) -> boolean: at most one unit in the last place apart; never for NaN, infinite or null."""

    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan)
        ok = np.isfinite(x) & np.isfinite(y)
        gap = np.maximum(np.spacing(np.abs(np.where(ok, x, 0))), np.spacing(np.abs(np.where(ok, y, 0))))
        return pd.Series(ok & (np.abs(np.where(ok, x, 0) - np.where(ok, y, 0)) <= gap))

    return within


@lru_cache(8)
def _pair_ranks(merges: tuple[tuple[str, str], ...]) -> dict:
    return {m: i for i, m in enumerate(merges)}


def merge_word(word: str, merges: tuple[tuple[str, str], ...]) -> list[str]:
    """Byte-pair merges of one word: the earliest rule first, until none applies."""
    ranks, parts = _pair_ranks(merges), list(word)
    while len(parts) > 1:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            break
        rule = merges[min(found)[0]]
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == rule:
                out.append("".join(rule))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def word_pieces(merges: list[tuple[str, str]]):
    """string -> array<string>: merged pieces of the words, cached in each worker."""
    rules = tuple(map(tuple, merges))

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        cache: dict[str, list[str]] = {}

        def of(w: str) -> list[str]:
            if w not in cache:
                cache[w] = merge_word(w, rules)
            return cache[w]

        return text.map(lambda t: [] if t is None else [p for w in t.split() for p in of(w)])

    return pieces


def span_mask(rate: float, longest: int, seed: int):
    """(key, n) -> array<struct<at, kind>>: masked spans of up to `longest` tokens (length k weighs 1/k), about `rate` of n.

    Four in five masked tokens become the mask token, one in ten another token, one in ten stays.
    """
    import zlib

    @F.pandas_udf("array<struct<at:int,kind:string>>")
    def mask(key: pd.Series, n: pd.Series) -> pd.Series:
        weights = 1 / np.arange(1, longest + 1)
        out = []
        for k, m in zip(key, n):
            rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
            want, hit = int(round(rate * m)), {}
            for start in rng.permutation(np.arange(1, m)).tolist() if m > 1 else []:
                if len(hit) >= want:
                    break
                for at in range(start, min(m, start + int(rng.choice(longest, p=weights / weights.sum())) + 1)):
                    if len(hit) < want:
                        hit.setdefault(at, str(rng.choice(["mask", "random", "keep"], p=[0.8, 0.1, 0.1])))
            out.append([{"at": a, "kind": c} for a, c in sorted(hit.items())])
        return pd.Series(out)

    return mask
