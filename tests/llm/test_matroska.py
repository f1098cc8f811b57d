import struct
from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborquery.llm import matroska as m


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=5000), st.integers(0, 60))
def test_round_trip(raw, times):
    payload = m.padded(raw * times)
    data = m.mux(payload)
    found = m.read(data)
    assert len(payload) % 64 == 0 and payload
    assert b"".join(data[p.offset : p.offset + p.size] for p in found.packets) == payload
    assert [p.timestamp_ns for p in found.packets] == [i * 64_000_000 for i in range(len(found.packets))]
    assert [c[2] for c in found.cues] == found.clusters


def block(flags, content, head=b"\x81"):
    return head + struct.pack(">hB", 5, flags) + content


@pytest.mark.parametrize(
    "flags, content, packets",
    [
        (0x00, b"abc", [b"abc"]),
        (0x02, bytes([2, 255, 1, 2]) + b"x" * 256 + b"yy" + b"zzz", [b"x" * 256, b"yy", b"zzz"]),
        (0x04, bytes([2]) + b"aabbcc", [b"aa", b"bb", b"cc"]),
        (0x06, bytes([2, 0x84, 0xBE]) + b"aaaabbbc", [b"aaaa", b"bbb", b"c"]),
    ],
)
def test_lacing_and_block_groups_in_clusters_of_unknown_size(flags, content, packets):
    group = m._node(m.GROUP, m._node(m.BLOCK, block(flags, content)), m._node(m.REFERENCE, b"\x01"))
    simple = m._node(m.SIMPLE, block(flags | 0x80, content))
    unknown = b"\x01" + b"\xff" * 7
    cluster = m.CLUSTER.to_bytes(4, "big") + unknown + m._uint(m.TIME, 100) + simple + group
    data = m._HEADER + m.SEGMENT.to_bytes(4, "big") + unknown + m._TRACKS + cluster + m._node(m.CLUSTER, m._uint(m.TIME, 200), simple)
    found = m.read(data)
    assert [data[p.offset : p.offset + p.size] for p in found.packets] == packets * 3
    assert [p.keyframe for p in found.packets] == [True] * len(packets) + [False] * len(packets) + [True] * len(packets)
    assert found.packets[0].timestamp_ns == 105_000_000 and found.packets[-len(packets)].timestamp_ns == 205_000_000
    assert found.tracks[1]["codec"] == "A_PCM/INT/LIT"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3000))
def test_broken_files_give_what_is_there(noise, cut):
    m.read(noise)
    found = m.read(m.mux(b"x" * 3008)[:cut])
    assert len(found.packets) <= 6


def test_query_rows(spark, odd_docs, no_docs, sf):
    rows = {r.doc_id: r for r in m.op7_media(spark, sf(documents=odd_docs)).collect()}
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload, got = m.padded(raw), rows[r.doc_id]
        data = m.mux(payload)
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256) == (len(raw), len(payload), sha256(payload).hexdigest())
        assert (got.tail_crc32, got.media_bytes, got.media_sha256) == (crc32(payload[-64:]), len(data), sha256(data).hexdigest())
    assert m.op7_media(spark, sf(documents=no_docs)).collect() == []
    assert m.packets(m.muxed(odd_docs.filter("doc_id = 4"))).count() == 2
