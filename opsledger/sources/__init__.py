"""Sources and sinks: settings files, complete file listings, command output, headers, catalogues."""
