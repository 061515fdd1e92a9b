"""Records through one external program per task, without ever holding a batch of its input or output."""

from __future__ import annotations

import subprocess
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Iterable, Iterator, Sequence

_TAIL = 40  # lines of its messages that a failure quotes
_TICK = 0.2  # seconds between looks at whether the program still does something


class ProgramFailed(RuntimeError):
    """The program ended badly, or did nothing for too long; ``key`` is the first record without an answer."""

    def __init__(self, message: str, key: str | None):
        super().__init__(message)
        self.key = key


class Program:
    """A running program that is fed from an iterator while its output is read.

    One thread writes records, as fast as the program takes them, and one reads its messages; the caller reads lines of output.
    What lies between is the pipes' own buffers, so memory doesn't depend on the number of records. Keys of records without an
    answer are kept, to name the one at which a program failed; ``answered`` takes off a key and those before it.
    """

    def __init__(self, command: Sequence[str], records: Iterable[tuple[str, str]], timeout: float):
        self.command, self.records, self.timeout = list(command), records, timeout
        self.waiting: OrderedDict[str, None] = OrderedDict()
        self.messages: deque[str] = deque(maxlen=_TAIL)
        self.done, self.late, self.moved = threading.Event(), False, time.monotonic()
        self.fetching = False  # the next record isn't there yet, which is no fault of the program
        self.broken: BaseException | None = None
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)
        self.threads = [threading.Thread(target=f, daemon=True) for f in (self._write, self._read_messages, self._watch)]
        for t in self.threads:
            t.start()

    def _write(self) -> None:
        try:
            records = iter(self.records)
            while True:
                self.fetching = True
                record = next(records, None)
                self.moved, self.fetching = time.monotonic(), False
                if record is None:
                    break
                self.waiting[record[0]] = None
                self.process.stdin.write(record[1])
        except BrokenPipeError:
            pass  # its status tells the rest
        except BaseException as e:  # of the records' source: for the caller to raise
            self.broken = e
        finally:
            self.fetching = False
            try:
                self.process.stdin.close()
            except OSError:
                pass

    def _read_messages(self) -> None:
        for line in self.process.stderr:
            self.messages.append(line.rstrip("\n"))

    def _watch(self) -> None:
        while not self.done.wait(_TICK):
            if not self.fetching and time.monotonic() - self.moved > self.timeout:
                self.late = True
                self.process.kill()
                return

    def answered(self, key: str) -> None:
        """The program answered ``key``: it is past the records that it got before."""
        if key in self.waiting:
            while self.waiting.popitem(last=False)[0] != key:
                pass

    def lines(self) -> Iterator[str]:
        """The program's output, line by line with its ends. Raises ``ProgramFailed`` if it doesn't end well."""
        try:
            for line in self.process.stdout:
                self.moved = time.monotonic()
                yield line
            self.process.wait(self.timeout)
            self.threads[0].join(self.timeout)
            if self.broken is not None:
                raise self.broken
            if self.late or self.process.returncode != 0:
                why = f"did nothing for {self.timeout} seconds" if self.late else f"ended with status {self.process.returncode}"
                key = next(iter(self.waiting), None)
                where = "after its last record" if key is None else f"at the record with key '{key}'"
                self.threads[1].join(1.0)
                raise ProgramFailed(f"{self.command[0]} {why} {where}: {' | '.join(self.messages)[-2000:]}", key)
        finally:
            self.done.set()
            if self.process.poll() is None:
                self.process.kill()


def started(command: Sequence[str], records: Iterator[tuple[str, str]], timeout: float) -> Program | None:
    """The program with its first record on the way; None, and nothing is started, if there is no record."""
    for first in records:
        return Program(command, _after(first, records), timeout)
    return None


def _after(first: tuple[str, str], rest: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    yield first
    yield from rest
