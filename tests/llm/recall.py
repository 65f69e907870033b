"""Share of planted pairs that the projection passes bring together: python -m tests.llm.recall 1000000"""

import sys

import numpy as np

from envmon.llm import embedding_dedup as E


def recall(n: int, pairs: int, cosine: float = 0.935, dim: int = 64, window: int = 128, miss: float = 0.005, seed: int = 1) -> float:
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((pairs, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    passes, bits = E.passes_for(n, 0.93, window, miss)
    planes = E._planes(dim, bits)
    sig = np.empty((n, bits // 8), np.uint8)
    sig[:pairs], sig[pairs:2 * pairs] = np.packbits(a @ planes > 0, axis=1), np.packbits(b @ planes > 0, axis=1)
    for at in range(2 * pairs, n, 100_000):
        x = rng.standard_normal((min(100_000, n - at), dim))
        sig[at:at + len(x)] = np.packbits(x @ planes > 0, axis=1)
    met, step = np.zeros(pairs, bool), bits // passes
    differ = np.bitwise_count(sig[:pairs] ^ sig[pairs:2 * pairs]).sum(axis=1) <= E.most_differing(bits, 0.93)
    for p in range(passes):
        first = p * step // 8  # the order of the first 64 hashes from the pass's own on decides
        lead = np.zeros(n, np.uint64)
        for k in range(9):
            byte = sig[:, (first + k) % (bits // 8)].astype(np.uint64)
            shift = 56 - 8 * k + p * step % 8
            lead |= byte << np.uint64(shift) if shift >= 0 else byte >> np.uint64(-shift)
        place = np.empty(n, np.int64)
        place[np.argsort(lead, kind="stable")] = np.arange(n)
        met |= np.abs(place[:pairs] - place[pairs:2 * pairs]) <= window
    return float((met & differ).mean())


if __name__ == "__main__":
    for size in map(int, sys.argv[1:]):
        print(size, E.passes_for(size, 0.93, 128, 0.005), recall(size, 2000), flush=True)
