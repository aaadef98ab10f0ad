"""A cap on what is under way at a time in all of a cluster's tasks.

The driver lends permits over TCP: a task connects, waits until it is told that it has one, and gives it back by closing the
connection. A task or executor that is lost closes its connection too, so no permit is lost with it. Tasks that wait cost the
driver a connection each, and no thread. Partitions stay as many as they are.
"""

from __future__ import annotations

import asyncio
import secrets
import socket
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

TOKEN_BYTES = 16


@dataclass(frozen=True)
class Permits:
    """Where to ask for permits; goes to the workers with the code that needs them."""

    host: str
    port: int
    token: bytes

    @contextmanager
    def one(self) -> Iterator[None]:
        """Holds a permit inside."""
        with socket.create_connection((self.host, self.port)) as s:
            s.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
            s.sendall(self.token)
            if s.recv(1) != b"1":
                raise ConnectionError("the driver lends no permits any more")
            yield


class Lender:
    """Lends ``most`` permits at a time, from a thread of the driver."""

    def __init__(self, host: str, most: int):
        self.most, self.lent, self.peak = most, 0, 0
        self.token = secrets.token_bytes(TOKEN_BYTES)
        self.loop = asyncio.new_event_loop()
        bound = socket.create_server(("", 0), backlog=4096)
        self.permits = Permits(host, bound.getsockname()[1], self.token)
        threading.Thread(target=self._run, args=(bound,), daemon=True, name="permits").start()

    def _run(self, bound: socket.socket) -> None:
        asyncio.set_event_loop(self.loop)
        self.free = asyncio.Semaphore(self.most)
        self.loop.run_until_complete(asyncio.start_server(self._lend, sock=bound))
        self.loop.run_forever()

    async def _lend(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        writer.get_extra_info("socket").setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
        try:
            if not secrets.compare_digest(await reader.readexactly(TOKEN_BYTES), self.token):
                return
            gone = asyncio.ensure_future(reader.read(1))
            mine = asyncio.ensure_future(self.free.acquire())
            await asyncio.wait({gone, mine}, return_when=asyncio.FIRST_COMPLETED)
            if not mine.done():  # it left while it waited
                mine.cancel()
                return
            try:
                self.lent += 1
                self.peak = max(self.peak, self.lent)
                writer.write(b"1")
                await writer.drain()
                await gone
            finally:
                self.lent -= 1
                self.free.release()
        except (ConnectionError, asyncio.IncompleteReadError, asyncio.CancelledError):
            pass
        finally:
            writer.close()


_LENDERS: dict[tuple[str, str, int], Lender] = {}


def lender(spark: SparkSession, pool: str, most: int) -> Lender:
    """The application's lender of ``pool``; all stages that ask the same service share one."""
    key = (spark.sparkContext.applicationId, pool, most)
    if key not in _LENDERS:
        _LENDERS[key] = Lender(spark.conf.get("spark.driver.host"), most)
    return _LENDERS[key]
