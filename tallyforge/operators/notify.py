"""Notifications of alert groups: waiting for a burst, telling of changes, repeating what lasts, suppressing the implied."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.timeutil import interval_us
from .machines import Fold, fold_keys


@dataclass(frozen=True)
class Route:
    """How long a new group waits, how often it may tell of changes, how often it repeats itself."""

    wait: str
    interval: str
    repeat: str


# The routes by severity, the one for all others, and the alert that only shows that alerting works.
ROUTES = {
    "critical": Route("10 seconds", "5 minutes", "30 minutes"),
    "warning": Route("30 seconds", "10 minutes", "2 hours"),
    "info": Route("30 seconds", "30 minutes", "24 hours"),
    "default": Route("30 seconds", "5 minutes", "4 hours"),
}
SILENT = "Watchdog"


def _implied(a: tuple, by: tuple) -> bool:
    """Does alert `by` make alert `a` superfluous? Both are (alertname, device type, severity, instance) of one device."""
    return (
        (by[0] == "ServiceDown" and a[0] in ("ServiceHighLatency", "SLABreachWarning") and a[3] == by[3])
        or (by[2] == "critical" and a[2] == "warning")
        or (by[0] == "InterfaceDown" and a[0] == "BandwidthSaturation")
    )


class Notifier(Fold):
    """The alerts of a device (of which an instance is a part), its groups, and when each group is looked at next.

    Inner state: active alerts by id, and for each group (alertname, device type, route) the next look, the alerts it has
    told of as firing, and when it last told of anything.
    """

    COLUMNS = ("alertname", "device_type", "severity", "instance", "alert_id", "firing")
    ORDER = ("firing", "alert_id")
    OUT = {"alertname": "string", "device_type": "string", "route": "string", "ts": "timestamp", "reason": "string", "n_firing": "long", "n_resolved": "long"}

    def __init__(self, routes: dict[str, Route] | None = None):
        self.routes = {k: tuple(interval_us(x) for x in (r.wait, r.interval, r.repeat)) for k, r in (routes or ROUTES).items()}

    def rows(self, key, inner, batch, now):
        active, groups = inner or ({}, {})
        out: list[tuple] = []
        for t, firing, alert, name, kind, severity, instance in batch:
            self._look(active, groups, t - 1, out)
            if name == SILENT:
                continue
            if not firing:
                active.pop(alert, None)
                continue
            active[alert] = (name, kind, severity, instance)
            group = (name, kind, severity if severity in self.routes else "default")
            groups.setdefault(group, [t + self.routes[group[2]][0], frozenset(), None])
        self._look(active, groups, now, out)
        return ((active, groups) if active or groups else None), out

    def _look(self, active: dict, groups: dict, upto: int, out: list[tuple]) -> None:
        """All looks at groups up to a time, in order; alerts do not change meanwhile."""
        while groups:
            group = min(groups, key=lambda g: (groups[g][0], str(g)))
            at, told, last = groups[group]
            if at > upto:
                return
            name, kind, route = group
            _, interval, repeat = self.routes[route]
            own = {i: a for i, a in active.items() if (a[0], a[1], a[2] if a[2] in self.routes else "default") == group}
            firing = frozenset(i for i, a in own.items() if not any(_implied(a, by) for by in active.values()))
            resolved = [i for i in told if i not in active]
            reason = None
            if firing - told:
                reason = "firing" if last is None else "changed"
            elif resolved:
                reason = "changed" if firing else "resolved"
            elif firing and at - last >= repeat:
                reason = "repeat"
            if reason:
                out.append((name, kind, route, at, reason, len(firing), len(resolved)))
                told, last = firing, at
            if own:
                groups[group] = [at + interval, told, last]
            else:
                del groups[group]

    def due(self, inner):
        return min((g[0] for g in inner[1].values()), default=None)


def notifications(alerts: DataFrame, until, routes: dict[str, Route] | None = None) -> DataFrame:
    """(device_id, alertname, device_type, route, ts, reason, n_firing, n_resolved): each notification up to the time `until`.

    `alerts` has the changes of alerts: device_id, alertname, device_type, severity, instance, alert_id, ts, and firing,
    true where an alert begins (or goes on) and false where it ends. A group is told of first when its `wait` is over, then at
    every `interval` if alerts have begun or ended since, else once `repeat` has passed; when its last alert has ended
    and that has been told, it is gone. An alert that another active one of its device implies is not told of. Ends come
    before beginnings of one time. Rows without a device are one device.
    """
    return fold_keys(alerts, ["device_id"], "ts", list(Notifier.ORDER), list(Notifier.COLUMNS), Notifier(routes), Notifier.OUT, until)
