"""Plain-Python restatement of the per-row context rules, used as
a brute-force reference on small random threads.  Nested loops over the
thread, one row at a time; deliberately nothing like the Spark plans."""

from __future__ import annotations

OP, COMMENT = "Original post", "Comment"


def s(x):
    return "" if x is None else str(x).strip()


def threaded(rows, i):
    r = rows[i]
    me, msg, rt, cat = r["user_id"], r["msg_id"], r["reply_to"], r["category"]
    out = f'We will be annotating Utterance #{i} from Message #{msg} by {me}:\n"{s(r["message"])}"\n'
    out += "\n**Local Context**:"
    sib = [x for x in rows if x["msg_id"] == msg]
    if len(sib) > 1:
        if cat == OP:
            out += "\nThe Utterance is part of the thread message. Read the full thread starter message for context."
        else:
            full = " ".join(t for t in (s(x["message"]) for x in sib) if t)
            out += f'\nThis utterance is part of the full message:\n"{full}"\n\nYou are asked only to annotate the Utterance #{i}".'
    if rt is not None and rt != "N/A":
        earlier = [x for x in rows[:i] if x["user_id"] == rt]
        if earlier:
            if cat == COMMENT:
                out += f'\nUtterance #{i} is a comment on the original post by "{rt}". Read the thread starter message for the context.'
            else:
                kept = [x for x in earlier if x["category"] != OP]
                out += f'\nUtterance #{i} is a reply to user "{rt}". The following earlier messages by {rt} may help contextualize the reply:'
                for m in sorted({x["msg_id"] for x in kept}):
                    out += f'\n- Message #{m}: "' + " ".join(s(x["message"]) for x in kept if x["msg_id"] == m) + '"'
    if cat != OP and rt is not None:
        same = lambda x: x["user_id"] == me and x["reply_to"] == rt and x["msg_id"] != msg
        before = [x for x in rows[:i] if same(x)]
        if before:
            m = before[-1]["msg_id"]
            out += f"\n\nPrevious message from {me} in this thread:"
            out += f'\n- Message #{m}: "' + " ".join(s(x["message"]) for x in rows if x["msg_id"] == m) + '"'
        after = [x for x in rows[i + 1:] if same(x)]
        if after:
            m = after[0]["msg_id"]
            out += f"\n\nNext message from {me} in this thread:"
            out += f'\n- Message #{m}: "' + " ".join(s(x["message"]) for x in rows if x["msg_id"] == m) + '"'
    later = [x for x in rows[i + 1:] if x["reply_to"] == me and x["user_id"] != me]
    if later:
        out += f"\n\nOther users replied to {me} afterward. Here are some such replies:"
        ids = []
        for x in later:
            if x["msg_id"] not in ids:
                ids.append(x["msg_id"])
        for m in sorted(ids[:2]):
            xs = [x for x in later if x["msg_id"] == m]
            out += f'\n- Message #{m} from {xs[0]["user_id"]}: "' + " ".join(s(x["message"]) for x in xs) + '"'
    return out


def sequential(rows, i):
    r = rows[i]
    text = s(r["message"])
    out = f'**Local Context**: We will be annotating Utterance #{r["msg_id"]} (#{r["utt_no"]}) from {r["user_id"]}:\n"{text}"\n'
    full = " ".join(t for t in (s(x["message"]) for x in rows if x["msg_id"] == r["msg_id"]) if t)
    out += f'The full message is:\n{full}\n\nYou are asked only to annotate the utterance "{text}".'
    if i > 0:
        p = rows[i - 1]
        out += f'\nThis follows the previous message from {p["user_id"]}:\n"{s(p["message"])}"'
    if i < len(rows) - 1:
        n = rows[i + 1]
        out += f'\n\nIt is followed by a message from {n["user_id"]}:\n"{s(n["message"])}"'
    return out


def pair(rows, i):
    threaded_sheet = any(s(x["reply_to"]) for x in rows)
    if threaded_sheet:
        rt = s(rows[i]["reply_to"]) if rows[i]["reply_to"] is not None else ""
        prev = ""
        if rt and rt != "N/A":
            hits = [x for x in rows[:i] if str(x["user_id"]) == rt]
            if hits:
                prev = hits[-1]["message"] or ""
        return prev, ""
    prev = (rows[i - 1]["message"] or "") if i > 0 else ""
    nxt = (rows[i + 1]["message"] or "") if i < len(rows) - 1 else ""
    return prev, nxt
