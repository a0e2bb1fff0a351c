"""Python rules in a process of their own, one for each Python worker.

A worker starts one helper (this module as a program) and keeps it. It sends a whole batch of
questions at once; the helper says when it begins a rule and what came out, so the worker
can end it where a rule takes too long, native code included. Rules that return something
to await wait together on the helper's event loop, each with a limit of its own.
"""

from __future__ import annotations

import asyncio
import atexit
import inspect
import os
import pickle
import select
import struct
import subprocess
import sys
from collections.abc import Callable

Question = tuple[str, str | None, str | None]  # kind, response, placeholder

#: What the helper says of a question: its number and one of these.
SAID = struct.Struct("<IB")
FAILED, PASSED, BEGUN, READY = range(4)
#: Rules that wait at the same time, and seconds beyond a limit after which the helper is ended.
TOGETHER, GRACE = 256, 0.3
#: How long a new helper may take to load the rules.
START = 120.0


def wanted_names(rule: Callable) -> frozenset[str]:
    """The arguments a rule takes; one whose signature cannot be read takes the response."""
    try:
        return frozenset(inspect.signature(rule).parameters)
    except (TypeError, ValueError):
        return frozenset(("response",))


def _ask(rule: Callable, wanted: frozenset[str], response: str | None, placeholder: str | None):
    offered = {"response": response} | ({} if placeholder is None else {"placeholder": placeholder})
    return rule(**{name: value for name, value in offered.items() if name in wanted})


def _clear(verdict) -> int:
    """Only a clear true passes."""
    return PASSED if str(verdict).strip().lower() == "true" else FAILED


async def _answer(rules: dict, seconds: float | None, questions: list[tuple[int, Question]], say: Callable) -> None:
    waiting: set[asyncio.Task] = set()

    async def awaited(number: int, verdict) -> None:
        try:
            say(number, _clear(await asyncio.wait_for(verdict, seconds)))
        except (Exception, SystemExit, asyncio.CancelledError):
            say(number, FAILED)

    for number, (kind, response, placeholder) in questions:
        say(number, BEGUN)
        try:
            verdict = _ask(*rules[kind], response, placeholder)
            if not inspect.isawaitable(verdict):
                say(number, _clear(verdict))
                continue
        except (Exception, SystemExit):
            say(number, FAILED)
            continue
        waiting.add(asyncio.ensure_future(awaited(number, verdict)))
        if len(waiting) >= TOGETHER:
            _, waiting = await asyncio.wait(waiting, return_when=asyncio.FIRST_COMPLETED)
    if waiting:
        await asyncio.wait(waiting)


def serve() -> None:
    """The helper: reads pickled rules or questions, each after its length, until its input ends."""
    source, sink = os.fdopen(os.dup(0), "rb"), os.fdopen(os.dup(1), "wb", 0)
    os.dup2(os.open(os.devnull, os.O_RDONLY), 0)
    os.dup2(2, 1)  # what rules print is no answer
    say = lambda number, what: sink.write(SAID.pack(number, what))
    loop = asyncio.new_event_loop()
    rules, seconds = {}, None
    while head := source.read(8):
        what, content = pickle.loads(source.read(int.from_bytes(head, "little")))
        if what == "rules":
            functions, seconds = pickle.loads(content[0]), content[1]
            rules = {kind: (rule, wanted_names(rule)) for kind, rule in functions.items()}
            say(0, READY)
        else:
            loop.run_until_complete(_answer(rules, seconds, content, say))


class Helper:
    """The other end: starts the process when it is first needed, ends it where it is stuck."""

    def __init__(self) -> None:
        self.process: subprocess.Popen | None = None
        self.loaded: tuple | None = None
        self.unread = b""

    def verdicts(self, rules: bytes, seconds: float | None, questions: list[Question]) -> list[bool]:
        """Which questions pass. Errors, exits, timeouts and a lost helper fail the rule that ran;
        where several had begun, each of them is asked again alone."""
        answers: list[bool | None] = [None] * len(questions)
        batches = [list(range(len(questions)))]
        while batches:
            batch = batches.pop()
            if not batch:
                continue
            begun = self._ask(rules, seconds, batch, questions, answers)
            rest = [k for k in batch if answers[k] is None]
            if not rest:
                continue
            self.close()
            if len(begun) > 1:
                batches += [[k] for k in begun]
                batches.append([k for k in rest if k not in begun])
            else:
                for k in begun or rest:
                    answers[k] = False
                batches.append([k for k in rest if answers[k] is None])
        return [answer is True for answer in answers]

    def _ask(self, rules: bytes, seconds: float | None, batch: list[int], questions: list[Question], answers: list) -> set[int]:
        """Fills in answers as far as they come; returns the questions that were begun only."""
        begun: set[int] = set()
        limit = None if seconds is None else seconds + GRACE
        try:
            self._load(rules, seconds)
            self._send(("questions", [(k, questions[k]) for k in batch]))
            left = len(batch)
            while left:
                number, said = self._heard(limit)
                if said == BEGUN:
                    begun.add(number)
                else:
                    begun.discard(number)
                    answers[number] = said == PASSED
                    left -= 1
        except (EOFError, OSError):
            pass
        return begun

    def _load(self, rules: bytes, seconds: float | None) -> None:
        if self.process is None:
            paths = os.pathsep.join(p for p in sys.path if p)
            self.process = subprocess.Popen(
                [sys.executable, "-m", __spec__.name if __spec__ else __name__],
                stdin=subprocess.PIPE,
                stdout=subprocess.PIPE,
                env=os.environ | {"PYTHONPATH": paths},
                bufsize=0,
            )
        if self.loaded != (rules, seconds):
            self._send(("rules", (rules, seconds)))
            if self._heard(START)[1] != READY:
                raise EOFError
            self.loaded = (rules, seconds)

    def _send(self, message) -> None:
        content = pickle.dumps(message, pickle.HIGHEST_PROTOCOL)
        view = memoryview(len(content).to_bytes(8, "little") + content)
        while view:
            view = view[self.process.stdin.write(view) :]

    def _heard(self, limit: float | None) -> tuple[int, int]:
        """The next thing said; too long a silence is an error."""
        pipe = self.process.stdout
        while len(self.unread) < SAID.size:
            if not select.select([pipe], [], [], limit)[0]:
                raise EOFError
            more = pipe.read(1 << 16)
            if not more:
                raise EOFError
            self.unread += more
        said, self.unread = SAID.unpack(self.unread[: SAID.size]), self.unread[SAID.size :]
        return said

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process.stdin.close()
            self.process.stdout.close()
        self.process = self.loaded = None
        self.unread = b""


#: The helper of this Python worker.
HELPER = Helper()
atexit.register(HELPER.close)


def ask(rules: bytes, seconds: float | None, questions: list[Question]) -> list[bool]:
    """Which questions pass, answered by this worker's helper; ``rules`` are pickled, by kind."""
    return HELPER.verdicts(rules, seconds, questions)


if __name__ == "__main__":
    serve()
