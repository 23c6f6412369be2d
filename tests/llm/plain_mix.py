"""The mix in plain Python, row by row."""

import re

from postlab.llm import mixing

WORD = re.compile(mixing.WORD)
P = mixing.PRIME


def mixed(x, salt):
    y = (x + salt * 1000003) % P
    for k in mixing.FACTORS:
        y = (y * y + k * y + 11) % P
    return y


def permuted(x, size, salt, rounds=mixing.ROUNDS):
    for r in range(rounds):
        number = mixed(r, salt)
        mirror = ((number * P + mixed(r + rounds, salt)) % size - x) % size
        spread = (max(x, mirror) % P * mixing.FACTORS[0] + number) % P
        if spread * spread % P % 2 == 1:
            x = mirror
    return x


def targets(sizes, weights, most):
    """Share by weight; what is above a source's bound is cut and shared again, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        rest = sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return names, target


def mix(rows, weights=(1, 2, 3), most=3, block=64, shard_slots=4096, seed=1):
    """Pieces (row, turn, first, n) of rows (row, id, source, text): the words that each use of a document takes."""
    size = {row: len(WORD.findall(text or "")) for row, _, _, text in rows}
    sizes = {}
    for row, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + size[row]
    names, target = targets(sizes, weights, most)
    groups = max(1, -(-len(rows) // mixing.GROUP_ROWS))
    shards = max(1, -(-sum(sizes.values()) // (block * shard_slots)))
    found = []
    for src, source in enumerate(names, 1):
        if not sizes[source]:
            continue
        n_blocks = -(-sizes[source] // block)
        n_slots = int(n_blocks * target[source] / sizes[source] + 0.5)
        own = sorted(
            (mixed((-1 if i is None else i) % P, seed + 3) % groups, i is not None, i or 0, row)
            for row, i, s, _ in rows if s == source and size[row])
        blocks, at = {}, 0
        for *_, row in own:
            for b in range(at // block, (at + size[row] - 1) // block + 1):
                low = max(at, b * block)
                blocks.setdefault(b, []).append((row, low - at, min(at + size[row], (b + 1) * block) - low))
            at += size[row]
        # the slots of a source are numbered shard after shard, so only their number matters here
        assert sum(1 for j in range(n_slots) if 0 <= mixed(j, src * 7 + seed) % shards < shards) == n_slots
        for j in range(n_slots):
            turn = j // n_blocks
            for row, first, n in blocks[permuted(j % n_blocks, n_blocks, src * 1009 + turn * 31 + seed)]:
                found.append((row, turn, first, n))
    return size, sizes, target, found


def used_texts(rows, **settings):
    """(row, text) of each use of a document."""
    size, _, _, pieces = mix(rows, **settings)
    text = {row: t for row, _, _, t in rows}
    uses = {}
    for row, turn, first, n in pieces:
        uses.setdefault((row, turn), []).append((first, n))
    found = []
    for (row, _), parts in uses.items():
        spaced = re.findall(mixing.SPACED_WORD, text[row])
        whole = sum(n for _, n in parts) == size[row]
        found.append((row, text[row] if whole else "".join(w for f, n in sorted(parts) for w in spaced[f:f + n])))
    return found
