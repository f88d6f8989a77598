"""The dialogue of one phone, message by message: the model that the composed dialogue is tested against."""

import re

from slotwise.functions.intents import CANCEL_WORDS, GREETING_WORDS, STATUS_WORDS

STEPS = ("start", "choose_dept", "choose_doctor", "choose_date", "choose_slot", "confirm_name", "idle")
_INT = re.compile(r"^[+-]?[0-9]+$")


class MemoryMenus:
    """Menu snapshot held in memory (used when its size is within the bound)."""

    def __init__(self, departments, doctors, dates, slots, leaves):
        self._departments = departments
        self._doctors = doctors
        self._dates = dates
        self._slots = slots
        self._leaves = leaves

    def departments(self) -> list[str]:
        return self._departments

    def doctors(self, dept: str) -> list[dict]:
        return self._doctors.get(dept, [])

    def dates(self, doctor_id: int) -> list[str]:
        return self._dates.get(doctor_id, [])

    def slots(self, doctor_id: int, day: str) -> list[str]:
        return self._slots.get((doctor_id, day), [])

    def on_leave(self, doctor_id: int, day: str) -> bool:
        return (doctor_id, day) in self._leaves


def _pick(text: str, options: list):
    if not _INT.match(text):
        return None
    i = int(text) - 1
    return options[i] if 0 <= i < len(options) else None


def step_once(step: str, data: dict, text: str, menus) -> tuple[str, dict, dict]:
    """One message through the dialogue: returns (next step, next payload,
    output fields).  ``text`` is the stripped, lower-cased message."""
    out = {"intent": "other", "command": None, "doctor_id": None, "date": None, "slot": None, "name": None}
    if text in CANCEL_WORDS:
        out.update(intent="cancel", command="cancel", reply_kind="cancel")
        return "start", {}, out
    if text in STATUS_WORDS:
        out.update(intent="status", command="status", reply_kind="status")
        return step, data, out
    greet = text in GREETING_WORDS
    if greet:
        out["intent"] = "greet"
    if greet or step not in STEPS[1:6]:
        depts = menus.departments()
        out["reply_kind"] = "departments"
        return "choose_dept", {"depts": depts}, out
    if step == "choose_dept":
        depts = data.get("depts", menus.departments())
        dept = _pick(text, depts)
        if dept is None:
            out["reply_kind"] = "reprompt"
            return step, data, out
        doctors = menus.doctors(dept)
        if not doctors:
            out["reply_kind"] = "no_doctors"
            return step, data, out
        out["reply_kind"] = "doctors"
        return "choose_doctor", {"dept": dept, "doctors": doctors}, out
    if step == "choose_doctor":
        doctor = _pick(text, data.get("doctors", []))
        if doctor is None:
            out["reply_kind"] = "reprompt"
            return step, data, out
        dates = menus.dates(doctor["id"])
        if not dates:
            out["reply_kind"] = "no_dates"
            return step, data, out
        out["reply_kind"] = "dates"
        return "choose_date", {"dept": data.get("dept"), "doctor": doctor, "dates": dates}, out
    if step == "choose_date":
        day = _pick(text, data.get("dates", []))
        if day is None:
            out["reply_kind"] = "reprompt"
            return step, data, out
        doctor = data.get("doctor") or {}
        slots = menus.slots(doctor.get("id"), day)
        if not slots:
            out["reply_kind"] = "no_slots"
            return step, data, out
        out["reply_kind"] = "slots"
        return "choose_slot", {"dept": data.get("dept"), "doctor": doctor, "date": day, "slots": slots}, out
    if step == "choose_slot":
        slot = _pick(text, data.get("slots", []))
        if slot is None:
            out["reply_kind"] = "reprompt"
            return step, data, out
        out["reply_kind"] = "ask_name"
        return "confirm_name", {**data, "slot": slot}, out
    # confirm_name
    name = text.strip().title()
    if len(name) < 2:
        out["reply_kind"] = "ask_name"
        return step, data, out
    doctor = data.get("doctor") or {}
    if menus.on_leave(doctor.get("id"), data.get("date")):
        out["reply_kind"] = "on_leave"
        return "start", {}, out
    out.update(command="book", doctor_id=doctor.get("id"), date=data.get("date"), slot=data.get("slot"),
               name=name, reply_kind="book")
    return "start", {}, out
