"""Corpus counts of words and word pairs, looked up by blocks of whole documents.

A block holds about BLOCK_TOKENS tokens as places in its own list of words. For each part of all pairs it sends one row with its distinct pairs
and how often it has them; the task of the part adds these up and answers with one number per pair, in the order they were sent. Words are
looked up in the same way. So no row is moved per token, no pair comes twice from one block, and a pair or word in every document is one
entry per block wherever it goes: no key is hot. A task holds one block, or one part of about PART_PAIRS pairs.

Words are strings, or numbers that stand for them (64-bit hashes, whose low bits are used as they are). The START word opens each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

BLOCK_TOKENS = 1 << 20
PART_PAIRS = 1 << 21
LEAST_PAIRS = 1 << 16
W_PARTS = 8


def _kit():
    """A function that gives the functions the tasks share; all are nested, so that they travel with a task."""
    def kit():
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def codes(words):
            """A number of 0 or more per word to deal it by: itself without its sign, or a hash of its bytes."""
            if pa.types.is_integer(words.type):
                return words.to_numpy(zero_copy_only=False) & np.int64(2**63 - 1)
            words = words.cast(pa.large_binary())
            _, ends, data = words.buffers()
            ends = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1]
            text = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1) if len(words) and data else np.zeros(0, np.uint64)
            ends = ends - ends[0] if len(words) else np.zeros(1, np.int64)
            power = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
            text *= power[(np.arange(len(text)) - np.repeat(ends[:-1], np.diff(ends))) % 256]
            whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text, dtype=np.uint64)])
            h = whole[ends[1:]] - whole[ends[:-1]]
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            return ((h ^ (h >> np.uint64(33))) >> np.uint64(1)).astype(np.int64)

        def flat(column):
            """The elements of a list column's rows, and how many each row has."""
            whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            return whole.flatten(), pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        def lists(values, sizes):
            values = values if isinstance(values, pa.Array) else pa.array(values)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

        def distinct(values):
            """Sorted distinct values (0 or more), each value's place among them, and how often each comes."""
            bits = len(values).bit_length()
            if len(values) and int(values.max()).bit_length() + bits < 64:
                s = np.sort(values << bits | np.arange(len(values)))  # several times faster than to sort their places
                order, s = s & ((1 << bits) - 1), s >> bits
            else:
                order = np.argsort(values, kind="stable")
                s = values[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            place = np.empty(len(s), np.int64)
            place[order] = np.cumsum(new) - 1
            return s[new], place, np.diff(np.append(np.flatnonzero(new), len(s)))

        def by_part(part):
            """The order by part, kept within a part; small numbers are sorted by radix."""
            return np.argsort((part + 1).astype(np.uint16) if len(part) and part.max() < 2**16 - 1 else part, kind="stable")

        def pairs_of(words, tokens, start, parts, hot):
            """The pairs of a block by place in ``words``: their tokens' places, the pair of each, the distinct pairs, their counts, the order in which
            they are sent and how many go to each part. Hot pairs go to part -1."""
            at = pc.index(words, pa.scalar(start, words.type)).as_py()
            keep = np.flatnonzero(tokens[1:] != at) + 1
            n = len(words)
            pairs, place, count = distinct(tokens[keep - 1].astype(np.int64) * n + tokens[keep])
            code, (a, b) = codes(words), parts
            part = np.mod(code, a)[pairs // n] * b + np.mod(code, b)[pairs % n] if len(pairs) else np.zeros(0, np.int64)
            known = np.full(len(pairs), -1)
            if hot is not None and len(hot["v"]) and len(pairs):
                v, w = (pc.fill_null(pc.index_in(pa.array(hot[c], words.type), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                        for c in "vw")
                mine = np.flatnonzero((v >= 0) & (w >= 0))
                key = v[mine] * n + w[mine]
                to = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                ok = pairs[to] == key
                part[to[ok]] = -1
                known[to[ok]] = mine[ok]
            order = by_part(part)
            return keep, place, pairs, count, order, part[order], known

        def runs(values):
            """Where the runs of equal values begin, and how long they are."""
            begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
            return begin, np.diff(np.append(begin, len(values)))
        return codes, flat, lists, distinct, by_part, pairs_of, runs
    return kit


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def token_blocks(texts: DataFrame, key: str, tokens: str, name: str, whole_keys: bool = False) -> DataFrame:
    """(block, keys, ends, words, tokens, n, n_words): blocks of the rows of ``texts`` that have a token after START, with which each begins. ``ends`` is
    where each row's tokens end. Written once, in row groups of a few blocks. With ``whole_keys`` the rows of one key are one row of one block (held whole by a task, as
    any text is); rows without a key stay apart."""
    rows = texts.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    if whole_keys:
        again = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        if again.limit(1).count():
            spread = F.when(F.col("key").isNull(), F.xxhash64("tokens")).otherwise(F.xxhash64("key"))
            rows = rows.withColumn("_h", spread).repartition("_h").sortWithinPartitions("_h", "key").drop("_h")
    most = BLOCK_TOKENS

    def build(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def block():
            words = pa.chunked_array([x.flatten() for x in held]).combine_chunks().dictionary_encode()
            size = np.concatenate([pc.list_value_length(x).to_numpy() for x in held]).astype(np.int64)
            key = pa.chunked_array(keys).combine_chunks()
            last = np.ones(len(key), bool)
            if whole_keys and len(key) > 1:
                last[:-1] = ~pc.fill_null(pc.equal(key.slice(1), key.slice(0, len(key) - 1)), False).to_numpy(zero_copy_only=False)
            end, key = np.cumsum(size)[last], key.filter(pa.array(last))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [one(key), one(pa.array(end.astype(np.int32))), one(words.dictionary), one(words.indices), pa.array([int(size.sum())]),
                 pa.array([len(words.dictionary)])], ["keys", "ends", "words", "tokens", "n", "n_words"])

        held, keys, n = [], [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 1))
            key, lists = batch.column(0), batch.column(1)
            size = pc.list_value_length(lists).to_numpy().astype(np.int64)
            begin = 0
            while begin < len(lists):
                if n >= most:
                    same = begin
                    if whole_keys:
                        prior = keys[-1][-1]
                        while prior.is_valid and same < len(lists) and key[same].is_valid and key[same] == prior:
                            same += 1
                    if same > begin:
                        held.append(lists.slice(begin, same - begin))
                        keys.append(key.slice(begin, same - begin))
                        n += int(size[begin:same].sum())
                        begin = same
                        continue
                    yield block()
                    held, keys, n = [], [], 0
                many = max(1, int(np.searchsorted(np.cumsum(size[begin:]), most - n, side="left")) + 1)
                held.append(lists.slice(begin, many))
                keys.append(key.slice(begin, many))
                n += int(size[begin:begin + many].sum())
                begin += many
        if n:
            yield block()

    made = rows.mapInArrow(build, f"keys array<{_kind(rows, 'key')}>, ends array<int>, words {_kind(rows, 'tokens')}, tokens array<int>, n long, n_words long")
    return materialize(made.withColumn("block", F.monotonically_increasing_id()), name, **{"parquet.block.row.count.limit": "4"})


def block_rows(blocks: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, tokens): the rows that ``blocks`` hold."""
    def read(batches):
        import numpy as np
        import pyarrow as pa
        _, flat, lists, _, _, _, _ = kit()
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ends, words, places = (flat(batch.column(j).slice(i, 1))[0] for j in range(4))
                yield pa.RecordBatch.from_arrays([keys, lists(words.take(places), np.diff(ends.to_numpy(zero_copy_only=False), prepend=0))], ["key", "tokens"])

    kit = _kit()
    got = blocks.select("keys", "ends", "words", "tokens").mapInArrow(read, f"key {_kind(blocks, 'keys')[6:-1]}, tokens {_kind(blocks, 'words')}")
    return got.select(F.col("key").alias(key), F.col("tokens").alias(tokens))


def pair_parts(blocks: DataFrame) -> tuple[int, int]:
    """Into how many parts pairs are dealt, by first and by second word: each of PART_PAIRS pairs or fewer, and not fewer than tasks where there
    are many. A first word in very many pairs is spread over W_PARTS parts."""
    n = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-n // PART_PAIRS), min(blocks.sparkSession.sparkContext.defaultParallelism * 2, n // LEAST_PAIRS))
    second = min(W_PARTS, parts)
    return -(-parts // second), second


def count_pairs(blocks: DataFrame, start, parts: tuple[int, int], types: str, hot: dict | None = None) -> DataFrame:
    """The counts of all pairs, to be written once: rows of kind "p" (block, part, x) answer the blocks. ``types`` names what is given of the distinct pairs
    of a part: "words" gives rows of kind "v" (a: first words, x: their tokens, y: their distinct pairs) and "w" (second words, alike); "again" gives
    rows of kind "a" (a, b: pairs that come more than once, x: how often). START pairs are not counted with "again". ``hot`` pairs are
    counted in parts, kind "h"."""
    word = _kind(blocks, "words")[6:-1]
    without_start = types == "again"

    def send(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        _, flat, lists, _, _, pairs_of, runs = kit()
        for batch in batches:
            for i in range(batch.num_rows):
                cols = {c: batch.column(j).slice(i, 1) for j, c in enumerate(batch.schema.names)}
                words, tokens = flat(cols["words"])[0], flat(cols["tokens"])[0].to_numpy(zero_copy_only=False)
                _, _, pairs, count, order, part, _ = pairs_of(words, tokens, start, parts, hot)
                if without_start:
                    keep = pairs[order] // len(words) != pc.index(words, pa.scalar(start, words.type)).as_py()
                    order, part = order[keep], part[keep]
                begin, size = runs(part)
                if not len(begin):
                    continue
                a, b = (words.take(pa.array(x)) for x in (pairs[order] // len(words), pairs[order] % len(words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begin), cols["block"][0].as_py(), np.int64)), pa.array(part[begin].astype(np.int32)), lists(a, size), lists(b, size),
                     lists(count[order].astype(np.int64), size)], ["block", "part", "a", "b", "x"])

    def add(table):
        import numpy as np
        import pyarrow as pa
        _, flat, lists, distinct, _, _, _ = kit()
        (a, size), (b, _), (x, _) = flat(table["a"]), flat(table["b"]), flat(table["x"])
        a, b = a.dictionary_encode(), b.dictionary_encode()
        ia, ib = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
        nb = len(b.dictionary)
        pairs, place, _ = distinct(ia * nb + ib)
        c = np.bincount(place, weights=x.to_numpy(zero_copy_only=False)).astype(np.int64)
        rows = pa.table({"block": table["block"], "part": table["part"], "kind": pa.array(["p"] * len(size)), "x": lists(c[place], size)})
        part = table["part"][0].as_py()

        def more(kind, a=None, b=None, x=None, y=None):
            one = {k: lists(v, [len(v)]) for k, v in (("a", a), ("b", b), ("x", x), ("y", y)) if v is not None}
            return pa.table({"part": pa.array([part], pa.int32()), "kind": pa.array([kind])} | one)
        out = []
        if part < 0:
            out.append(more("h", a.dictionary.take(pa.array(pairs // nb)), b.dictionary.take(pa.array(pairs % nb)), c))
            rows = rows.slice(0, 0)
        elif types == "words":
            for kind, i, d in (("v", pairs // nb, a.dictionary), ("w", pairs % nb, b.dictionary)):
                tokens = np.bincount(i, weights=c, minlength=len(d)).astype(np.int64)
                out.append(more(kind, d, None, tokens, np.bincount(i, minlength=len(d)).astype(np.int64)))
        else:
            two = c > 1
            out.append(more("a", a.dictionary.take(pa.array(pairs[two] // nb)), b.dictionary.take(pa.array(pairs[two] % nb)), c[two]))
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("a", pa.list_(a.dictionary.type)),
                            ("b", pa.list_(a.dictionary.type)), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64()))])
        full = lambda t: pa.table({f.name: t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema})
        return pa.concat_tables([full(t) for t in (rows, *out)])

    kit = _kit()
    sent = blocks.select("block", "words", "tokens").mapInArrow(send, f"block long, part int, a array<{word}>, b array<{word}>, x array<long>")
    return sent.groupBy("part").applyInArrow(add, f"block long, part int, kind string, a array<{word}>, b array<{word}>, x array<long>, y array<long>")


def word_parts(blocks: DataFrame, most: int) -> int:
    """Into how many parts words are dealt, so that a task answers for about ``most`` words of blocks."""
    n = blocks.agg(F.sum("n_words")).first()[0] or 0
    return max(1, -(-n // most), min(blocks.sparkSession.sparkContext.defaultParallelism * 2, n // LEAST_PAIRS))


def word_figures(blocks: DataFrame, parts: int, figures: DataFrame | None = None, word: str | None = None) -> DataFrame:
    """Rows of kind "w" (block, part, x, y, z) with up to three whole numbers per word of each block, from the columns of ``figures`` after
    ``word``, which are added up by word; 0 where there is no row. Without ``figures`` x is how often the word comes in all blocks. A row of kind "t"
    per part has in x how many words there are and the sum of theirs."""
    values = [c for c in figures.columns if c != word] if figures is not None else []
    kind = _kind(blocks, "words")[6:-1]
    own = figures is None

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        codes, flat, lists, _, by_part, _, runs = kit()

        def dealt(words, block, columns):
            part = np.mod(codes(words), parts)
            order = by_part(part)
            begin, size = runs(part[order])
            n = len(begin)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array(part[order][begin].astype(np.int32)), lists(words.take(pa.array(order)), size)]
                + [lists(c.take(pa.array(order)), size) if c is not None else pa.nulls(n, pa.list_(pa.int64())) for c in columns],
                ["block", "part", "a", "x", "y", "z"])
        for batch in batches:
            if batch.schema.names[0] == "block":
                for i in range(batch.num_rows):
                    words, n = flat(batch.column(1).slice(i, 1))[0], None
                    if own:
                        tokens = flat(batch.column(2).slice(i, 1))[0].to_numpy(zero_copy_only=False)
                        n = pa.array(np.bincount(tokens, minlength=len(words)).astype(np.int64))
                    yield dealt(words, batch.column(0)[i].as_py(), [n, None, None])
            elif batch.num_rows:
                yield dealt(batch.column(0), None, (list(batch.columns[1:]) + [None] * 3)[:3])

    def answer(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        _, flat, lists, _, _, _, _ = kit()
        told = table.filter(pc.is_valid(table["x"]))
        asks = table.filter(pc.is_valid(table["block"]))
        a, size = flat(asks["a"])
        known = flat(told["a"])[0].dictionary_encode()
        n = len(known.dictionary)
        at = pc.fill_null(pc.index_in(a, value_set=known.dictionary), n).to_numpy(zero_copy_only=False)
        out = {"block": asks["block"].combine_chunks(), "part": asks["part"].combine_chunks(), "kind": pa.array(["w"] * len(size), pa.string())}
        for c in "xyz":
            x = flat(told[c])[0].to_numpy(zero_copy_only=False)
            got = np.bincount(known.indices.to_numpy(zero_copy_only=False), weights=x, minlength=n + 1) if len(x) else np.zeros(n + 1)
            out[c] = lists(got.astype(np.int64)[at], size)
            if c == "x":
                total = [n, int(got.sum())]
        rest = {"block": pa.nulls(1, pa.int64()), "part": table["part"].slice(0, 1).combine_chunks(), "kind": pa.array(["t"]), "x": pa.array([total], pa.list_(pa.int64())),
                "y": pa.nulls(1, pa.list_(pa.int64())), "z": pa.nulls(1, pa.list_(pa.int64()))}
        return pa.concat_tables([pa.table(out), pa.table(rest)])

    kit = _kit()
    schema = f"block long, part int, a array<{kind}>, x array<long>, y array<long>, z array<long>"
    rows = blocks.select("block", "words", *(["tokens"] if own else [])).mapInArrow(deal, schema)
    if not own:
        rows = rows.unionByName(figures.select(word, *[F.col(c).cast("long") for c in values]).mapInArrow(deal, schema))
    return rows.groupBy("part").applyInArrow(answer, "block long, part int, kind string, x array<long>, y array<long>, z array<long>")


def block_scores(blocks: DataFrame, pairs: DataFrame, words: DataFrame, start, parts: tuple[int, int], n_word_parts: int, score,
                 key: str, hot: dict | None = None, without_start: bool = False) -> DataFrame:
    """(key, sum_lp, n_tokens) of the rows of ``blocks``: ``score(np, b)`` gives the two arrays from the block's arrays: ``doc``, ``v``, ``w`` (places
    in its words) and ``pair`` per token, ``pairs`` (v * number of words + w) with their ``c_vw``, and the word figures ``x``, ``y``, ``z``."""
    key_kind = _kind(blocks, "keys")[6:-1]
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    cols = {"block": "bigint", "part": "int", "kind": "string", "keys": types["keys"], "ends": types["ends"], "words": types["words"],
            "tokens": types["tokens"], "x": "array<bigint>", "y": "array<bigint>", "z": "array<bigint>"}
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in cols.items()])
    rows = full(blocks.withColumn("kind", F.lit("b"))).unionByName(full(pairs.where("kind = 'p'"))).unionByName(full(words.where("kind = 'w'")))

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        codes, flat, _, _, by_part, pairs_of, _ = kit()
        kinds = table["kind"]
        b = table.filter(pc.equal(kinds, "b"))
        if b.num_rows != 1:
            raise RuntimeError(f"block {table['block'][0]} was found {b.num_rows} times")

        def answers(kind, columns):
            got = table.filter(pc.equal(kinds, kind))
            got = got.take(pc.sort_indices(got["part"]))
            return [flat(got[c])[0].to_numpy(zero_copy_only=False) for c in columns]
        words, tokens = flat(b["words"])[0], flat(b["tokens"])[0].to_numpy(zero_copy_only=False)
        ends = flat(b["ends"])[0].to_numpy(zero_copy_only=False)
        keep, place, pair, _, order, _, known = pairs_of(words, tokens, start, parts, hot)
        n = len(words)
        at = pc.index(words, pa.scalar(start, words.type)).as_py()
        asked = known[order] < 0
        if without_start:
            asked &= pair[order] // n != at
        c_vw = np.zeros(len(pair), np.int64)
        told, = answers("p", "x")
        if len(told) != asked.sum():
            raise RuntimeError(f"{asked.sum()} pairs were asked for, {len(told)} answered")
        c_vw[order[asked]] = told
        if hot is not None:
            c_vw[known >= 0] = np.array(hot["c"], np.int64)[known[known >= 0]]
        order = by_part(np.mod(codes(words), n_word_parts))
        figures = []
        for told in answers("w", "xyz"):
            f = np.zeros(n, np.int64)
            f[order] = told
            figures.append(f)
        doc = np.searchsorted(ends, keep, side="right")
        sum_lp, n_tokens = score(np, {"doc": doc, "n_docs": len(ends), "v": tokens[keep - 1], "w": tokens[keep], "pair": place, "pairs": pair, "c_vw": c_vw,
                                      "n_words": n, "start": at, **dict(zip("xyz", figures, strict=True))})
        return pa.table({"key": flat(b["keys"])[0], "sum_lp": pa.array(sum_lp.astype(np.float64)), "n_tokens": pa.array(n_tokens.astype(np.int64))})

    kit = _kit()
    got = rows.groupBy("block").applyInArrow(run, f"key {key_kind}, sum_lp double, n_tokens long")
    return got.withColumnRenamed("key", key)
