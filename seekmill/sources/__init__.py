"""Sources and sinks: dumps, files, web pages, exports, table stores."""
