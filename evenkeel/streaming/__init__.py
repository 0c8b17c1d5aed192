"""Progress, remaining time and stragglers of running tasks, over tables of status reports."""
