"""Security-event analytics as Spark DataFrame transforms.

Raw log lines become one event table; keyed event-time detectors turn events into
matches; matches fold into alerts; alerts and events feed investigation reports.
"""
