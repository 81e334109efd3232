"""Brute-force versions of operators, for tests."""

import math
from collections import Counter

from corpusloom.llm import mixing, toxicity


def check_mix(rows, figures, copies, near=mixing.NEAR):
    """Holds ``copies``, {index: copies} of ``rows`` (source, size, u), against Pareto sampling by definition.

    figures: source -> (source_size, target).  In each source the sample has the n documents that the
    inclusion probabilities add up to; it is the Pareto sample but for documents exchanged around the cut;
    and no exchange of one of them brings its words nearer.
    """
    for source, (total, target) in figures.items():
        own = {i: (size, u) for i, (s, size, u) in enumerate(rows) if s == source}
        whole = math.floor(target / total + 1e-12) if total else 0
        extra = {i for i in own if copies[i] > whole}
        assert all(copies[i] - whole == (i in extra) for i in own)
        rest = target - whole * total
        if rest <= 1e-9 * target:
            assert not extra
            continue
        weight = {i: 2.0 ** (math.floor(math.log2(size) * mixing.STEPS + 1e-9) * mixing.TILT / mixing.STEPS) for i, (size, _) in own.items() if size > 0}
        sure: set = set()
        while True:  # documents that reach 1 are certain
            free = [i for i in weight if i not in sure]
            scale = (rest - sum(own[i][0] for i in sure)) / sum(weight[i] * own[i][0] for i in free)
            more = {i for i in free if scale * weight[i] >= 1}
            if not more:
                break
            sure |= more
        n = round(len(sure) + scale * sum(weight[i] for i in free))
        odds = lambda i: own[i][1] / (1 - own[i][1]) * (1 - scale * weight[i]) / (scale * weight[i])
        order = sorted(free, key=odds)
        cut = n - len(sure)
        assert len(extra) == n and sure <= extra
        pareto, around = set(order[:cut]), set(order[max(0, cut - near) : cut + near])
        assert (extra - sure) ^ pareto <= around
        short = rest - sum(own[i][0] for i in extra)
        assert abs(short) <= abs(rest - sum(own[i][0] for i in sure | pareto)) + 1e-6
        if len(order) <= near and abs(short) >= 1:  # those exchanged don't move again
            a, b = [own[i][0] for i in pareto & extra], [own[i][0] for i in set(order) - pareto - extra]
            assert all(abs(short - (y - x)) >= abs(short) - 1e-6 for x in a for y in b)


def word_ratios(labelled: list[tuple[bytes, int]], words: list[bytes]) -> list[float]:
    """The log-ratio of each of ``words`` by the definition, from texts and labels."""
    seen = [Counter(), Counter()]
    for text, toxic in labelled:
        seen[toxic].update(set(toxicity.words_of(text)))
    own: list[dict[bytes, Counter]] = [{}, {}]
    low: dict[bytes, Counter] = {}
    begin, end = b"\x01", b"\x02"
    for c in (0, 1):
        for w, n in seen[c].items():
            for i, byte in enumerate(w + end):
                own[c].setdefault(w[:i], Counter())[byte] += n
    for w in {*seen[0], *seen[1]}:
        s = begin + w + end
        for i in range(1, len(s)):
            for back in range(toxicity.BACK + 1):
                if back <= i:
                    low.setdefault(s[i - back : i], Counter())[s[i]] += 1

    def shared(before: bytes, byte: int) -> float:
        lower = shared(before[1:], byte) if before else 1 / 256
        here = low[before]
        return (max(here[byte] - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT * len(here) * lower) / here.total()

    def p(c: int, before: bytes, byte: int, lower: float) -> float:
        here = own[c].get(before)
        if not here:
            return lower
        return (max(here[byte] - toxicity.DISCOUNT, 0) + min(toxicity.DISCOUNT * len(here), here.total()) * lower) / here.total()

    out = []
    for w in words:
        total = 0.0
        for i, byte in enumerate(w + end):
            if not own[0].get(w[:i]) and not own[1].get(w[:i]):
                break  # both give what the shared model gives, here and from here on
            known = any(own[c].get(w[:i], {}).get(byte) for c in (0, 1))
            lower = shared((begin + w)[: i + 1][-toxicity.BACK:], byte) if known else 1.0
            total += math.log(p(1, w[:i], byte, lower) / p(0, w[:i], byte, lower))
        out.append(total)
    return out


def evidence(text: bytes, ratios: dict[bytes, float], mix: float) -> float:
    """What ``toxicity`` finds in a text, from the words' log-ratios."""
    words = toxicity.words_of(text)
    return sum(math.log1p(mix * math.expm1(ratios[w])) for w in words) / len(words) if words else 0.0
