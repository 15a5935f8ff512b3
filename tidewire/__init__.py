"""tidewire: news, indicator and weather-alert intelligence as Spark jobs."""

__version__ = "0.1.0"
