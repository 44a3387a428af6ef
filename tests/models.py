"""Plain Python models of the ordered operators, for randomised comparison."""


def dedup(rows):
    """rows: (stdin, out, repeat) in order -> (index, repeat)."""
    kept = []
    for i, (stdin, out, repeat) in enumerate(rows):
        if kept and rows[kept[-1][0]][:2] == (stdin, out):
            kept[-1][1] += 1
        else:
            kept.append([i, repeat])
    return [tuple(k) for k in kept]


def chunks(times, max_commands, gap, min_commands):
    """Lists of event positions per chunk."""
    splits = []
    for i, t in enumerate(times):
        if splits and t - times[i - 1] < gap and len(splits[-1]) < max_commands:
            splits[-1].append(i)
        else:
            splits.append([i])
    merged, pending = [], []
    for n, split in enumerate(splits):
        pending = pending + split
        if len(pending) >= min_commands or n == len(splits) - 1:
            if len(pending) < min_commands and merged:
                merged[-1].extend(pending)
            else:
                merged.append(pending)
            pending = []
    return merged


def transcript_events(chunks, cap=262144):
    """(stdin, cwd, exit, duration, stdout, chunk index) of a byte stream."""
    import base64
    import re

    stream = b"".join(chunks)
    ends, n = [], 0
    for c in chunks:
        n += len(c)
        ends.append(n)
    events, at, output = [], 0, None
    for m in re.finditer(rb"\x1b\]7770;([^\x07]*)\x07", stream):
        if output is not None:
            output += stream[at : m.start()]
        at, body = m.end(), m.group(1)
        if body == b"S":
            output = b""
        elif body.startswith(b"E;") and len(body) > 2:
            parts = body[2:].split(b";", 3)
            out, output = (output or b"")[:cap], None
            if len(parts) < 4:
                continue
            try:
                command = base64.b64decode(parts[3], validate=True)
            except ValueError:
                continue
            number = [
                int(p) if re.fullmatch(rb"[+-]?[0-9]+", p) else 0 for p in parts[:2]
            ]
            row = next(i for i, e in enumerate(ends) if e >= m.end())
            events.append(
                (command.decode(), parts[2].decode(), *number,
                 out.decode("utf-8", "replace"), row)
            )
    return events
