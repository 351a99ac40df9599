"""Sources of sensor rows and resource documents."""
