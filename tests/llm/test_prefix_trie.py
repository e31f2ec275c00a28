"""The trie against one built from Python's lists, with containers and segments small enough to burst and to be cut."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from plotshift.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuild(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            conv[c].append(((t is not None, t or 0, tie), r, x))
    seq = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    out = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = seq.get(donor, [])[:h] + own[h:]
    return out


def nodes(seqs):
    members, children = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m, kids = members[p], children[p]
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out[p] = (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), sum(out[k][5] for k in kids) or 1,
            own + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


@pytest.fixture(scope="module")
def made(spark):
    rng, rows = random.Random(5), []
    for c in [*range(40), -3, -8, 2**62 + 1]:
        first = rng.choice([0, 1])
        for t in range(rng.choice([1, 2, 3, 8, 9, 10, 14])):
            text = None if rng.random() < 0.1 else f"é{rng.choice([0, 0, 0, 1]) if t > 1 else first}"
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", None]), text, "x"))
    for c in range(100, 130):  # copies
        rows += [(c, t, "u", f"same {t}", "x") for t in range(12)]
    rows += [(77, t, "u", f"long {t % 7}", "x") for t in range(40)] + [(None, 1, "u", "n", "x")] * 3 + [(5, 1, "u", "twice", "x")] * 4
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").cache()


@pytest.mark.parametrize("segment,container", [(256, 4096), (4, 1), (3, 5)])
def test_nodes(made, segment, container):
    rows = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.ordered(made)), segment, container).select(*COLUMNS).collect()
    want = nodes(rebuild([tuple(r) for r in made.select("conv_id", "turn", "role", "text").collect()]))
    assert sorted((tuple(r) for r in rows), key=str) == want


def test_registered_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = nodes(rebuild([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))
    assert sorted((tuple(r) for r in prefix_trie.report(table).select(*COLUMNS).collect()), key=str) == want


def test_turnless_and_empty(spark, made):
    # conversation 4's own turn lies within the turns to be replaced, and its donor does not exist
    h = zlib.crc32(b"4") % 9
    assert h > 0
    one = spark.createDataFrame([(4, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    rows = prefix_trie.report(one).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves) for r in rows] == [(4, 0, 1, 0, 1)]
    assert rows[0].ends_sha256 == hashlib.sha256(b"4").hexdigest()
    assert prefix_trie.report(made.limit(0)).count() == 0


def test_common():
    a, b = b"x" * 16 + b"y" * 16, b"x" * 16 + b"y" * 15 + b"z"
    assert (prefix_trie.common(a, b), prefix_trie.common(a, a), prefix_trie.common(a, b""), prefix_trie.common(a, a + b)) == (1, 2, 0, 2)
