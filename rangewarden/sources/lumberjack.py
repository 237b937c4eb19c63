"""SRC-7 to 9: log shippers that speak the Lumberjack protocol (version 2) over TCP.

Each window of events becomes one file of a landing folder, a JSON object a line, written under another
name and renamed; only then is the window acknowledged. A stream of that folder is the source, so what
was acknowledged survives a lost driver, and what wasn't is sent again.
"""

from __future__ import annotations

import json
import os
import socketserver
import struct
import threading
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MAX_FRAME = 64 << 20


@dataclass
class Stats:
    batches: int = 0
    events: int = 0
    errors: int = 0
    last_batch: float = 0.0


class ProtocolError(ValueError):
    pass


def frames(read) -> Iterator[tuple[str, int, dict | None]]:
    """Frames from a reader of n bytes: ('W', size of the window, None) or ('J', sequence, event). Compressed frames are opened in place."""
    while head := read(2):
        if head[:1] != b"2":
            raise ProtocolError("not version 2")
        kind = head[1:2]
        if kind == b"W":
            yield "W", struct.unpack(">I", read(4))[0], None
        elif kind == b"J":
            sequence, size = struct.unpack(">II", read(8))
            if size > MAX_FRAME:
                raise ProtocolError("frame too large")
            yield "J", sequence, json.loads(read(size))
        elif kind == b"C":
            size = struct.unpack(">I", read(4))[0]
            if size > MAX_FRAME:
                raise ProtocolError("frame too large")
            body, at = zlib.decompress(read(size)), 0

            def inner(n: int, body: bytes = body) -> bytes:
                nonlocal at
                got = body[at : at + n]
                at += len(got)
                return got

            yield from frames(inner)
        else:
            raise ProtocolError(f"unknown frame {kind!r}")


class LumberjackServer:
    """Listens on host and port (0: any free one) and fills a landing folder."""

    def __init__(self, folder: str, host: str = "0.0.0.0", port: int = 5044, read_timeout: float = 5.0):
        os.makedirs(folder, exist_ok=True)
        self.stats, self.folder, self.lock = Stats(), folder, threading.Lock()
        outer = self

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                self.request.settimeout(None)
                stream = self.request.makefile("rb")

                def read(n: int) -> bytes:
                    got = stream.read(n)
                    if got and len(got) < n:
                        raise ProtocolError("the frame is cut off")
                    return got

                held, want, last = [], 0, 0
                try:
                    for kind, number, event in frames(read):
                        if kind == "W":
                            held, want = [], number
                            self.request.settimeout(read_timeout)
                        else:
                            held.append(event)
                            last = number
                        if want and len(held) >= want:
                            outer.land(held)
                            self.request.sendall(b"2A" + struct.pack(">I", last))
                            held, want = [], 0
                            self.request.settimeout(None)
                except (ProtocolError, ValueError, OSError, struct.error, zlib.error):
                    with outer.lock:
                        outer.stats.errors += 1

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address = daemon_threads = True

        self.server = Server((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def land(self, events: list[dict]) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        hidden = os.path.join(self.folder, f".{name}")
        with open(hidden, "w", encoding="utf-8") as f:
            events = [e for e in events if isinstance(e, dict)]
            f.writelines(json.dumps({"message": e["message"] if isinstance(e.get("message"), str) else None}) + "\n" for e in events)
            f.flush()
            os.fsync(f.fileno())
        os.replace(hidden, os.path.join(self.folder, name))
        with self.lock:
            self.stats.batches += 1
            self.stats.events += len(events)
            self.stats.last_batch = time.time()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def stream_events(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """The landing folder as a stream of messages."""
    return spark.readStream.schema("message string").option("maxFilesPerTrigger", max_files).json(folder)
