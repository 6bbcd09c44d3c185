"""Running programs on test cases, in Arrow batches: each case is a process of its own, forked from a bare interpreter, with limits of
time, memory and files.

The limits stop runaway programs. They are no sandbox against malice: executors that score code should have no network and no
rights worth stealing.
"""

from __future__ import annotations

import json
import math
import os
import re
import selectors
import signal
import socket
import subprocess
import sys
import tempfile
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.session import ship

_BLOCK = re.compile(r"```python\n(.*?)```", re.DOTALL)
#: Calls a function, or a method of ``Solution``, with the JSON lines of the input, and prints what it returns as JSON.
_CALL = """
import json as _json, sys as _sys
_args = [_json.loads(x) for x in _sys.stdin.read().splitlines() if x.strip()]
_f = getattr(Solution(), {name!r}) if "Solution" in globals() else {name}
print(_json.dumps(_f(*_args)))
"""


def program(text: str) -> str:
    """The last fenced Python block, or the whole text."""
    blocks = _BLOCK.findall(text)
    return blocks[-1] if blocks else text


#: A bare interpreter that forks a child for each case: starting one anew costs a hundred times as much. It answers with the child's
#: pid and then with its status; the child is a session of its own, and what it leaves behind ends before it is reaped.
_LAUNCHER = """
import atexit, gc, os, resource, signal, socket, sys
gc.collect()
gc.freeze()
_own = socket.socket(fileno=int(sys.argv[1]))
while True:
    _message, _fds, _, _ = socket.recv_fds(_own, 1 << 16, 2)
    if not _message:
        os._exit(0)
    _pid = os.fork()
    if not _pid:
        break
    for _fd in _fds:
        os.close(_fd)
    _own.send(str(_pid).encode())
    os.waitid(os.P_PID, _pid, os.WEXITED | os.WNOWAIT)
    try:
        os.killpg(_pid, signal.SIGKILL)
    except (ProcessLookupError, PermissionError):
        pass
    _own.send(str(os.waitpid(_pid, 0)[1]).encode())
os.setsid()
_cpu, _memory, _path = _message.decode().split(":", 2)
os.chdir(os.path.dirname(_path))
os.dup2(_fds[0], 0)
os.dup2(_fds[1], 1)
_own.detach()
os.closerange(3, 1024)
for _what, _bound in ((resource.RLIMIT_CPU, int(_cpu)), (resource.RLIMIT_AS, int(_memory) << 20), (resource.RLIMIT_FSIZE, 1 << 20), (resource.RLIMIT_NOFILE, 64)):
    resource.setrlimit(_what, (_bound, _bound))
sys.argv = [_path]
_main = sys.modules["__main__"] = type(sys)("__main__")
_main.__file__, _main.__builtins__ = _path, __builtins__
with open(_path, "rb") as _f:
    _source = _f.read()
try:
    exec(compile(_source, _path, "exec"), _main.__dict__)
    _code = 0
except SystemExit as _e:
    _code = 0 if _e.code is None else _e.code if isinstance(_e.code, int) else 1
except BaseException:
    os._exit(1)
if _code & 255:
    os._exit(_code & 255)
# What an interpreter does at its end, but for taking down its own modules.
try:
    if "threading" in sys.modules:
        sys.modules["threading"]._shutdown()
    atexit._run_exitfuncs()
    if sys.stdout is not None and not sys.stdout.closed:
        sys.stdout.flush()
    _d = _main.__dict__
    for _first in (True, False):
        for _k in list(_d):
            if _k != "__builtins__" and (_k[:1] == "_" and _k[:2] != "__") >= _first:
                _d[_k] = None
    gc.collect()
    for _s in {id(_s): _s for _s in (sys.stdout, sys.__stdout__) if _s is not None and not _s.closed}.values():
        _s.flush()
except BaseException:
    os._exit(120)
os._exit(0)
"""


class _Launcher:
    """The launcher of this process; one case at a time."""

    current: _Launcher | None = None

    def __init__(self) -> None:
        self.owner = os.getpid()
        self.end, far = socket.socketpair(socket.AF_UNIX, socket.SOCK_SEQPACKET)
        self.process = subprocess.Popen(
            [sys.executable, "-I", "-c", _LAUNCHER, str(far.fileno())], env={"PATH": os.environ.get("PATH", "")}, pass_fds=[far.fileno()],
            stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True,
        )
        far.close()

    @classmethod
    def get(cls) -> _Launcher:
        own = cls.current
        if own is None or own.owner != os.getpid() or own.process.poll() is not None:
            own = cls.current = cls()
        return own

    def close(self) -> None:
        self.end.close()
        self.process.kill()
        self.process.wait()
        self.process.stdout.close()
        _Launcher.current = None

    def run(self, path: str, given: str, seconds: float, memory_mb: int) -> bytes | None:
        """What the program of a file prints; null where it fails or runs out of time or memory."""
        with open(f"{os.path.dirname(path)}/.given", "w+b") as source:
            source.write(given.encode())
            source.seek(0)
            os.unlink(source.name)
            reader, writer = os.pipe()
            try:
                socket.send_fds(self.end, [f"{math.ceil(seconds) + 1}:{memory_mb}:{path}".encode()], [source.fileno(), writer])
            finally:
                os.close(writer)
        out, pid = [], 0
        until = time.monotonic() + seconds
        with open(reader, "rb", buffering=0) as printed, selectors.DefaultSelector() as ready:
            pid = int(self.end.recv(64))
            ready.register(printed, selectors.EVENT_READ)
            ready.register(self.end, selectors.EVENT_READ)
            status = None
            while ready.get_map():
                events = ready.select(max(0.0, until - time.monotonic()))
                if not events:  # out of time
                    break
                for key, _ in events:
                    if key.fileobj is printed:
                        if block := printed.read(1 << 16):
                            out.append(block)
                        else:
                            ready.unregister(printed)
                    else:
                        status = int(self.end.recv(64))
                        ready.unregister(self.end)
            else:
                return b"".join(out) if status == 0 else None
            if status is None:
                for kill in (os.killpg, os.kill):  # a child that is too young has no session yet
                    try:
                        kill(pid, signal.SIGKILL)
                    except ProcessLookupError:
                        pass
                self.end.recv(64)
        return None


def output_of(code: str, given: str, seconds: float = 10.0, memory_mb: int = 1024, name: str | None = None) -> str | None:
    """What a program prints for an input; null where it fails or runs out of time or memory."""
    source = code + (_CALL.format(name=name) if name else "")
    with tempfile.TemporaryDirectory() as own:
        with open(f"{own}/program.py", "w", encoding="utf-8") as f:
            f.write(source)
        launcher = _Launcher.get()
        try:
            out = launcher.run(f"{own}/program.py", given, seconds, memory_mb)
            return None if out is None else out.decode().replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            return None
        except (OSError, ValueError):  # the program ended its launcher; the next case gets another
            launcher.close()
            return None


def same_output(got: str | None, want: str) -> bool:
    """Equal word by word, numbers to a relative 1e-6."""
    if got is None:
        return False

    def near(a: str, b: str) -> bool:
        if a == b:
            return True
        try:
            return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-9)
        except ValueError:
            return False

    a, b = got.split(), want.split()
    return len(a) == len(b) and all(map(near, a, b))


def results(text: str | None, cases: str | dict | None, seconds: float = 10.0, memory_mb: int = 1024, first: int | None = None) -> list[bool]:
    """Per test case, whether the program of a text prints what it should. ``cases``: JSON of ``inputs``, ``outputs`` and perhaps ``fn_name``."""
    try:
        c = json.loads(cases) if isinstance(cases, str) else cases or {}
        name, pairs = c.get("fn_name"), list(zip(c["inputs"], c["outputs"]))[:first]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    out = []
    for given, want in pairs:
        if name:
            given = "\n".join(json.dumps(x) for x in given) if isinstance(given, list) else str(given)
            got = output_of(program(text or ""), given, seconds, memory_mb, name)
            try:
                value = json.loads(want) if isinstance(want, str) else want
                out.append(got is not None and json.loads(got) in (value, value[0] if isinstance(value, list) and len(value) == 1 else value))
            except ValueError:
                out.append(False)
        else:
            out.append(same_output(output_of(program(text or ""), str(given), seconds, memory_mb), str(want)))
    return out


def code_score(text: str | None, cases: str | dict | None, continuous: bool = True, seconds: float = 10.0, memory_mb: int = 1024) -> float:
    """1 if all cases pass; else, where ``continuous``, the share of the first ten that do. Without cases 0."""
    if continuous:
        head = results(text, cases, seconds, memory_mb, 10)
        return sum(head) / len(head) if head else 0.0
    every = results(text, cases, seconds, memory_mb)
    return float(bool(every) and all(every))


def code_score_udf(text, cases, continuous: bool = True, seconds: float = 10.0, memory_mb: int = 1024) -> Column:
    """:func:`code_score` per row; a null text is not run and has no score."""
    ship()

    def run(texts: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else code_score(t, c, continuous, seconds, memory_mb) for t, c in zip(texts, truths)], dtype=float)

    return F.pandas_udf(run, "double")(text, cases)
