import hashlib
import random

import pytest

from sitewright.llm import bpe, chat
from sitewright.llm.queries import vocabulary, with_control_strings

tiktoken = pytest.importorskip("tiktoken")
TEXTS = [
    "", None, "a", " ", "\n\n \t x", "<|endoftext|> is text", "Ünïcode ßtraße 🙂🙂 café", "it's we'll I'D", "1234567 89.5", "aab" * 30_000,
    "x" * 3000 + " " * 200 + "y", " leading and trailing  ", "end of line　", "\x00\x1c\x85",
]


def library():
    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_tokens_equal_the_library_and_decode_to_the_text(docs_of):
    path, pattern = vocabulary()
    rows = list(enumerate(TEXTS)) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = docs_of(rows, extra=("ids", "n_tokens"))
    own = library()
    want = sorted((str(i), own.encode_ordinary(t or "")) for i, t in rows)
    tokens = bpe.encode(docs, path, pattern)
    assert sorted((str(r.doc_id), r.ids) for r in tokens.collect()) == want
    back = bpe.decode(tokens, path)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    digests = bpe.round_trip(docs, path, pattern).collect()
    for r in digests:
        text = [t or "" for i, t in rows if i == r.doc_id and (i != 3 or t == "again" or r.n_tokens > 1)]
        assert r.decoded_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in text} | {hashlib.sha256(b" ").hexdigest()}
    by_id = {r.doc_id: r for r in digests if r.doc_id not in (3, None)}
    for i, t in rows:
        if i in by_id:
            ids = own.encode_ordinary(t or "")
            assert by_id[i].n_tokens == len(ids)
            assert by_id[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(docs_of([]), path, pattern).count() == 0


def test_both_folds_equal_the_library():
    ranks = bpe.read_ranks(vocabulary()[0])
    own = library()
    choose = random.Random(4)
    for _ in range(300):
        word = "".join(choose.choice("etaoinshrdluç") for _ in range(choose.randint(1, 120)))
        assert bpe.fold(word.encode(), ranks) == bpe._fold_long(word.encode(), ranks) or len(word) == 1
        assert bpe.fold(word.encode(), ranks) == own.encode_ordinary(word)


HARD = ["", None, "<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_sep|>", "<", "|x", "\\|", "<\\", "\x00\x00", "<|0|>", "a\nb", "<\\\\|", "$1 \\"]


def chats_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, formatted string")


def test_chat_reads_back_what_was_formatted(spark):
    choose = random.Random(7)
    rows = []
    for conv in range(40):
        for turn in range(choose.randint(1, 9)):
            rows.append((conv, turn, choose.choice(["user", "assistant", "assistant", "system", None, "od\\n\nd<|"]), choose.choice(HARD), "x", "y"))
    rows += [(None, 0, "user", "no conversation", "x", "y"), (50, 1, "assistant", "late", "x", "y"), (50, None, "user", "first", "x", "y")]
    rows += [(51, t, "assistant" if t % 3 else "user", f"t{t}", "x", "y") for t in range(4000)]
    mixed = rows[:]
    choose.shuffle(mixed)
    read = {r.conv_id: r for r in chat.read_back(chat.format_chats(chats_of(spark, mixed))).collect()}
    by_conv = {}
    for c, turn, role, text, *_ in rows:
        by_conv.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(read) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort(key=lambda t: t[0])
        assert [(t["role"], t["text"]) for t in read[c].turns] == [(r, t) for _, r, t in turns]
        assert read[c].learned == "".join(t for _, r, t in turns if r == "assistant")
    assert chat.format_chats(chats_of(spark, [])).count() == 0


def test_adjacent_turns_share_a_block_and_labels_cover_the_output(spark):
    rows = with_control_strings(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    assert got[1].formatted == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_sep|>c<|im_end|>\n"
    for r in got.values():
        assert len(r.labels) == len(r.formatted)
        assert all(m in (chat.IGNORED, c) for m, c in zip(r.labels, r.formatted))
    assert got[-1].formatted.count("<|im_start|>") == 2
