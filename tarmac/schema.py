"""Column names. Every operator takes them as parameters; these are the flight defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FlightColumns:
    date: str = "FlightDate"
    carrier: str = "Reporting_Airline"
    number: str = "Flight_Number_Reporting_Airline"
    origin: str = "Origin"
    dest: str = "Dest"
    tail: str = "Tail_Number"
    dep_hhmm: str = "CRSDepTime"
    arr_hhmm: str = "CRSArrTime"
    dep_local: str = "dep_dt_local"
    arr_local: str = "arr_dt_local"
    dep_utc: str = "dep_utc"
    arr_utc: str = "arr_utc"
    dep_delay: str = "DepDelayMinutes"
    arr_delay: str = "ArrDelayMinutes"
    air_time: str = "AirTime"
    wheels_off: str = "WheelsOff"
    row_id: str = "flight_id"

    @property
    def flight_key(self) -> list[str]:
        return [self.carrier, self.number, self.origin, self.dest]

    @property
    def route_key(self) -> list[str]:
        return [self.carrier, self.origin, self.dest]


FLIGHT = FlightColumns()
