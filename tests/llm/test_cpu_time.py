"""Operators whose CPU seconds were over their limits: words and texts are not handled one by one where arrays do it."""

import time

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from linelake.llm import hmm, packing


class Rows:
    """Stands for a table: gives back what would be run on its batches."""

    def select(self, *_):
        return self

    filter = select

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def cpu(f, times=3):
    """The least CPU seconds of some calls."""
    took = []
    for _ in range(times):
        t = time.process_time()
        f()
        took.append(time.process_time() - t)
    return min(took)


PIECES = st.sampled_from(["a", "A", "ab", "b\0", "\0", "é", "漢字", "x" * 7, "y" * 8, "z" * 9, "w" * 255, "w" * 256, "w" * 257, "w" * 300, " ", "\t\n", "\v\f", "\r", " ", "\x1c", "0"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6))
def test_names_of_words(texts):
    data = [x.encode() for x in texts]
    names, n = hmm.word_names(data)
    want = [x.lower().split() for x in data]
    words = [w for own in want for w in own]
    assert n.tolist() == [len(own) for own in want] and len(names) == len(words)
    found = dict(zip(words, names.tolist()))
    assert len(set(found.values())) == len(found) and all(found[w] == k for w, k in zip(words, names.tolist()))
    assert all(k & (hmm.CLASSES - 1) == xxhash.xxh3_64_intdigest(w[-2:]) & (hmm.CLASSES - 1) and 1 << 62 <= k < 1 << 63 for w, k in found.items())


def test_head_finds_places():
    r = np.random.default_rng(3)
    for size in (0, 1, 20, 5000):
        names = np.unique(r.integers(1 << 62, (1 << 63) - 1, size))
        names = np.append([hmm.END], names) if size != 1 else names
        close = np.concatenate([names[names > 0], names[names > 0] + 1, names[names > 0] - 1, [1 << 62, (1 << 63) - 2]])
        at = hmm.Head(names)(close)
        place = {k: i for i, k in enumerate(names.tolist())}
        assert at.tolist() == [place.get(k, -1) for k in close.tolist()]


def test_words_are_counted_with_little_more_than_splitting():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x:x}" for x in r.integers(0, 1 << 40, 2000).tolist()) for _ in range(100)]
    data = [x.encode() for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    run = hmm._counts(Rows())
    n = sum(sum(b.column(1).to_pylist()) for b in run([batch]))
    assert n == 2001 * 100
    assert cpu(lambda: list(run([batch]))) < 6 * cpu(lambda: [x.lower().split() for x in data])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join), st.integers(0, 300))
def test_longest_run(text, least):
    data = text.encode()
    want = max(map(len, data.split()), default=0)
    assert packing.longest_run(data, least) == (want if len(data) >= least else 0)


def test_long_runs_are_told_with_little_more_than_encoding():
    """Runs without white space of almost the length that goes to the other tokenizer, as tables and links have."""
    e = packing.encoder(packing.default_vocabulary())
    text = " ".join([",".join(["ab", "12"] * 750)] * 20)
    assert packing.longest_run(text.encode(), packing.LONG_RUN) < packing.LONG_RUN
    assert e(text.encode()).tolist() == e.slow.encode(text, add_special_tokens=False).ids
    assert cpu(lambda: e(text.encode())) < 2 * cpu(lambda: e.fast.encode_to_numpy(text))
