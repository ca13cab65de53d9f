"""The retry policy of fetching, as a function over any transport."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

# Fixed values.
BUSY = (429, 503)
LONGEST_WAIT = 30


class FetchError(Exception):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass
class Reply:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


def wait_after(reply: Reply | None, attempt: int) -> float:
    """Seconds before the next attempt: what a busy server asks for, or longer each time."""
    if reply is not None and reply.status in BUSY:
        asked = next((v for k, v in reply.headers.items() if k.lower() == "retry-after"), "")
        return min(int(asked) if asked.isdigit() else 5 * attempt, LONGEST_WAIT)
    return 3 * attempt


def fetch_with_retry(get: Callable[[str], Reply], url: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """The first good reply; every other status, and a transport error, is tried again up to ``attempts`` times."""
    last = FetchError("not tried")
    for attempt in range(1, attempts + 1):
        reply = None
        try:
            reply = get(url)
            if reply.status < 400:
                return reply
            last = FetchError(f"status {reply.status}", reply.status)
        except OSError as e:
            last = FetchError(str(e))
        if attempt < attempts:
            sleep(wait_after(reply, attempt))
    raise last


def pages(urls, get: Callable[[str], Reply], url_col: str = "url", sleep: Callable[[float], None] = time.sleep):
    """(url, status, body, error) of a DataFrame of addresses; a failure is a row, not the end of the job."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for url in b.column(0).to_pylist():
                try:
                    r = fetch_with_retry(get, url, sleep=sleep)
                    rows.append((url, r.status, r.body, None))
                except FetchError as e:
                    rows.append((url, e.status, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["url", "status", "body", "error"])

    return urls.select(url_col).mapInArrow(run, "url string, status int, body binary, error string")
