import json
import socket
import struct
import time
import zlib

from rangewarden.sources.lumberjack import LumberjackServer, stream_events


def event(n, message):
    body = json.dumps({"message": message}).encode()
    return b"2J" + struct.pack(">II", n, len(body)) + body


def test_windows_are_landed_then_acknowledged(spark, tmp_path):
    server = LumberjackServer(str(tmp_path / "in"), "127.0.0.1", 0)
    with socket.create_connection(("127.0.0.1", server.port), timeout=5) as s:
        s.sendall(b"2W" + struct.pack(">I", 2) + event(1, "one") + event(2, "two"))
        assert s.recv(6) == b"2A" + struct.pack(">I", 2)
        packed = zlib.compress(event(3, "three\nlines") + event(4, None))
        s.sendall(b"2W" + struct.pack(">I", 2) + b"2C" + struct.pack(">I", len(packed)) + packed)
        assert s.recv(6) == b"2A" + struct.pack(">I", 4)
    with socket.create_connection(("127.0.0.1", server.port), timeout=5) as s:
        s.sendall(b"xx")
        assert s.recv(1) == b""
    time.sleep(0.2)
    assert (server.stats.batches, server.stats.events, server.stats.errors) == (2, 4, 1)
    server.close()
    got = []
    q = stream_events(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: got.extend(r[0] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, got)) == ["None", "one", "three\nlines", "two"]
